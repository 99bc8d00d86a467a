"""Words of whole texts as arrays: their 64-bit hashes, and hashes of runs of consecutive words."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from cartolyte.llm.pretokens import _BETWEEN, _char_values, _mix

#: White space that separates words: [\\x20\\x09-\\x0D].
_BLANKS = np.zeros(33, bool)
_BLANKS[[32, *range(9, 14)]] = True


class Words(NamedTuple):
    """The words of a block of texts. ``first[d]`` to ``first[d + 1]`` are text d's words."""

    hashes: np.ndarray
    first: np.ndarray
    points: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


def split_words(texts: list[str]) -> Words:
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    edge = np.array([_BETWEEN], "<u4").tobytes()
    points = np.frombuffer(edge.join(t.encode("utf-32-le") for t in texts) + edge, "<u4")
    blank = _BLANKS[np.minimum(points, 32)] & (points <= 32)
    text_ends = np.cumsum(lens + 1) - 1
    blank[text_ends] = True
    word = ~blank
    begins = np.flatnonzero(word & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(blank & np.concatenate([[False], word[:-1]]))
    first = np.concatenate([[0], np.searchsorted(begins, text_ends)])
    if not len(begins):
        return Words(np.zeros(0, np.uint64), first, points, begins, ends)
    within = np.arange(len(points), dtype=np.uint64)
    steps = np.diff(np.concatenate([[0], begins, [len(points)]]))
    within -= np.repeat(np.concatenate([[0], begins]), steps).astype(np.uint64)
    with np.errstate(over="ignore"):
        values = _char_values()[points] * (_mix(within) | np.uint64(1))
        values[blank] = 0
        hashes = _mix(np.add.reduceat(values, begins) ^ _mix((ends - begins).astype(np.uint64)))
    return Words(hashes, first, points, begins, ends)


def run_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of every run of ``k`` consecutive words; run i starts at word i. Runs may cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = _mix(np.arange(k, dtype=np.uint64) + np.uint64(7919 * (seed + 1))) | np.uint64(1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += hashes[j : j + n] * factors[j]
        return _mix(out)


def text_of(first: np.ndarray, n: int) -> np.ndarray:
    """The text that each of ``n`` words belongs to."""
    return np.searchsorted(first, np.arange(n), side="right") - 1
