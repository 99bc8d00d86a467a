"""Whole texts to pretokens with array operations, and a bounded table of the distinct pretokens seen so far.

The pattern is that of byte-level BPE vocabularies: contractions, runs of letters, numbers or other signs with one
leading space, and white space. Its rules are local, so class changes between neighbouring characters give all token
starts of a block of texts at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

_BLANK, _LETTER, _NUMBER, _SIGN, _EDGE = range(5)
#: Stands between texts; one above the last code point.
_BETWEEN = 0x110000
#: Characters handled at once.
BLOCK_CHARS = 500_000
#: Contractions that are tokens of their own (fixed values of the pattern).
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point, one byte each; made once per worker."""
    from tokenizers import Regex, pre_tokenizers

    # By the engine whose cuts are to be met, as versions of Unicode differ in what is assigned. No text holds surrogates.
    known = np.concatenate([np.arange(0xD800), np.arange(0xE000, _BETWEEN)])
    table = np.full(_BETWEEN + 1, _SIGN, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _BLANK)):
        runs = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for i in range(0, len(known), 4096):  # faster than the whole at once
            part = known[i : i + 4096]
            for _, (begin, end) in runs.pre_tokenize_str("".join(map(chr, part.tolist()))):
                table[part[begin:end]] = kind
    table[_BETWEEN] = _EDGE
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values of consecutive integers."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _char_values() -> np.ndarray:
    return _mix(np.arange(_BETWEEN + 1, dtype=np.uint64) + np.uint64(1 << 40))


def token_starts(points: np.ndarray) -> np.ndarray:
    """A flag for each character at which a pretoken, or an edge between texts, starts."""
    kind = _classes()[points]
    n = len(kind)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    blank = kind == _BLANK
    # A blank before a word: its own start, and a plain space takes the word with it.
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & (kind[1:] != _EDGE)
    start |= last
    joined = np.flatnonzero(last & (points == 32)) + 1
    start[joined] = False
    # Contractions: the apostrophe starts a token and takes one or two letters.
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    if len(quote):
        padded = np.append(points, (_BETWEEN, _BETWEEN))
        for c in _CONTRACTIONS:
            hit = quote[(padded[quote + 1] == ord(c[1])) & (len(c) == 2 or padded[quote + 2] == ord(c[-1]))]
            start[hit + 1] = False
            after = hit + len(c)
            after = after[after < n]
            start[after] |= kind[after] != _EDGE
    start |= kind == _EDGE
    edge_next = np.flatnonzero(kind == _EDGE)[:-1] + 1 if n and kind[-1] == _EDGE else np.flatnonzero(kind == _EDGE) + 1
    start[edge_next] = True
    return start


class WordTable:
    """Distinct pretokens with their ids. ``encode`` maps a list of byte strings to a flat id array and the counts.

    Holds ``most`` pretokens at most, then starts anew; this bounds memory and never changes a result. Pretokens are told
    apart by a 64-bit hash of their characters and length alone: of 500,000 different ones two share theirs with a
    probability of 7e-9, and one of them would then get the other's ids.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 500_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes, ascending, and their slots
        self.flat, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def slots(self, points: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The table's slot of each pretoken."""
        within = np.arange(len(points), dtype=np.uint64)
        within -= np.repeat(begins, lengths).astype(np.uint64)
        with np.errstate(over="ignore"):
            hashes = np.add.reduceat(_char_values()[points] * (_mix(within) | np.uint64(1)), begins) ^ _mix(lengths.astype(np.uint64))
        codes, distinct = pd.factorize(hashes)
        if len(self.keys) + len(distinct) > self.most:
            self._clear()
        place = np.searchsorted(self.keys, distinct)
        missing = np.flatnonzero(np.append(self.keys, np.uint64(0))[place] != distinct) if len(self.keys) else np.arange(len(distinct))
        missing = np.union1d(missing, np.flatnonzero(place == len(self.keys))) if len(self.keys) else missing
        if len(missing):
            at = np.full(len(distinct), -1, np.int64)
            at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            words = []
            for b, n in zip(begins[at[missing]].tolist(), lengths[at[missing]].tolist()):
                words.append(b"" if points[b] == _BETWEEN else points[b : b + n].tobytes().decode("utf-32-le").encode())
            flat, count = self.encode(words)
            fresh = len(self.count) + np.arange(len(missing), dtype=np.int32)
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            keys, slot = np.concatenate([self.keys, distinct[missing]]), np.concatenate([self.slot, fresh])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slot = keys[order], slot[order]
        return self.slot[np.searchsorted(self.keys, distinct)][codes]


def gather(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices of consecutive pieces first..first+count-1, one piece after the other."""
    total = int(count.sum())
    return np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)


def blocks(texts: list[str], size: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``size`` characters, one text at least."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def cut_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, begins, lengths, ends): the texts' characters, their pretokens, and for each text the pretoken after its last.

    An edge between texts is a pretoken too, one without ids.
    """
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    edge = np.array([_BETWEEN], "<u4").tobytes()
    points = np.frombuffer(edge.join(t.encode("utf-32-le") for t in texts) + edge, "<u4")
    begins = np.flatnonzero(token_starts(points))
    return points, begins, np.diff(np.append(begins, len(points))), np.searchsorted(begins, np.cumsum(lens + 1))


def encode_texts(texts: list[str], words: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, flat, and the number of ids of each text."""
    points, begins, lengths, ends = cut_words(texts)
    slots = words.slots(points, begins, lengths)
    count = words.count[slots]
    upto = np.concatenate([[0], np.cumsum(count)])
    return words.flat[gather(words.first[slots], count)], np.diff(upto[ends], prepend=0)


def sentence_ends(points: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A flag for each pretoken: it ends with a full stop or the like, and white space or the text's end follows."""
    after = begins + lengths
    kind = _classes()[points[np.minimum(after, len(points) - 1)]]
    return np.isin(points[after - 1], np.array([ord(c) for c in ".!?\n。！？"])) & ((kind == _BLANK) | (kind == _EDGE) | (points[after - 1] == 10))
