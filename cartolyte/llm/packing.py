"""Order-preserving packing of documents into sequences by dynamic programming.

The documents of a Spark partition, in its order, form a stream of tokens. A sequence is a window of that stream, and
its cuts are chosen among document ends and sentence ends; only a sentence longer than a sequence, which must be cut, has
places inside it too. A cut costs nothing at a document's end, ``SENTENCE_COST`` at a sentence's end and
``TRUNCATION_COST`` inside a sentence; a sequence costs ``SEQUENCE_COST`` and its padding. The cheapest cuts follow from

    cost[j] = cut_cost[j] + SEQUENCE_COST + min over i in the window of (cost[i] + length - (pos[j] - pos[i]))

whose window minimum a monotone queue gives in constant time, and from the few exact power-of-two lengths, which need
no padding. The stream is cut into blocks of about half a million characters, each packed by itself, so memory is bounded
and a block's last sequence is the only one that the block's end cuts short. Nothing is shuffled.

Defined cases: a null text counts as empty and is the end id alone; repeated rows are packed each; a text longer than
a sequence spans several; an empty table gives an empty result; other columns are ignored. A task that is run again
packs its partition in the same way, as sequence ids derive from the partition's number and order.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolyte.llm.common import ids_as_text, ids_restored
from cartolyte.llm.pretokens import WordTable, blocks, cut_words, gather, sentence_ends

LENGTH = 1024
END_ID = 0
SENTENCE_COST, TRUNCATION_COST, SEQUENCE_COST = 2, 8, 256
#: Step of the places inside a sentence that is longer than a sequence, in tokens.
GAP_STEP = 8
#: Powers of two that a sequence may have as its length without padding; smaller ones give too many sequences.
POWERS = (64, 128, 256, 512)


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, specials


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it prints, else the next free code point from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def _words(path: str) -> WordTable:
    """Words are encoded one by one by tiktoken, from the tokenizer's own vocabulary: the same ids in less time."""
    import tiktoken

    tokenizer, specials = _tokenizer(path)
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if token not in specials}
    piece = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def encode(words: list[bytes]):
        ids = [piece(w) if w else [] for w in words]
        return np.array([i for x in ids for i in x], np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    return WordTable(encode)


def token_stream(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc_ends, sentence_ends): each text's ids and the end id, and the positions after which a text or a sentence ends."""
    tokenizer, specials = _tokenizer(path)
    odd = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if any(s in t for s in specials)}
    words = _words(path)
    points, begins, lengths, ends = cut_words(["" if i in odd else t for i, t in enumerate(texts)])
    slots = words.slots(points, begins, lengths)
    # Each text's edge, the last of its pretokens, stands for the end id.
    flat, first, count = np.append(words.flat, END_ID), words.first[slots], words.count[slots]
    first[ends - 1], count[ends - 1] = len(words.flat), 1
    for i, ids in odd.items():
        first[ends[i] - 1], count[ends[i] - 1] = len(flat), len(ids) + 1
        flat = np.concatenate([flat, np.array([*ids, END_ID], flat.dtype)])
    upto = np.cumsum(count)
    return flat[gather(first, count)].astype("<u4"), upto[ends - 1], upto[sentence_ends(points, begins, lengths)]


def places(total: int, doc_ends: np.ndarray, sentences: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may be, from 0 to the stream's end, and what a cut costs there."""
    at = np.unique(np.concatenate([[0], doc_ends, sentences, [total]]))
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > length)
    inner = (gaps[wide] - 1) // GAP_STEP
    more = np.repeat(at[wide], inner) + (gather(np.zeros(len(wide), np.int64), inner) + 1) * GAP_STEP
    every = np.union1d(at, more)
    cost = np.full(len(every), TRUNCATION_COST)
    cost[np.searchsorted(every, at)] = SENTENCE_COST
    cost[np.searchsorted(every, doc_ends)] = 0
    cost[[0, -1]] = 0
    return every, cost


def cheapest_cuts(at: np.ndarray, cut_cost: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The chosen cuts among ``at``, both ends included."""
    n = len(at)
    exact: dict[int, list[int]] = {}
    for power in POWERS:
        if power < length:
            j = np.searchsorted(at, at - power)
            hit = np.flatnonzero(at[np.minimum(j, n - 1)] == at - power)
            for k, i in zip(hit.tolist(), j[hit].tolist()):
                exact.setdefault(k, []).append(i)
    pos, extra = at.tolist(), (cut_cost + SEQUENCE_COST).tolist()
    cost, back, queue = [0] * n, [0] * n, deque([(0, 0, 0)])  # queue: (cost + position, position, index), rising
    for j in range(1, n):
        here = pos[j]
        while queue[0][1] < here - length:
            queue.popleft()
        key, _, i = queue[0]
        best = key + length - here
        for k in exact.get(j, ()):
            if cost[k] < best:
                best, i = cost[k], k
        best += extra[j]
        cost[j], back[j] = best, i
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return at[cuts[::-1]]


def pack(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` their ids."""
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids

    def run(frames):
        sequence = TaskContext.get().partitionId() << 32
        for frame in frames:
            texts, doc_ids = frame["text"].fillna("").tolist(), frame["doc_id"].to_numpy()
            for a, b in blocks(texts):
                ids, doc_ends, sentences = token_stream(texts[a:b], path)
                cuts = cheapest_cuts(*places(len(ids), doc_ends, sentences, length), length)
                bounds = np.union1d(cuts, doc_ends)
                bounds = bounds if bounds[0] == 0 else np.insert(bounds, 0, 0)
                begin, end = bounds[:-1], bounds[1:]
                doc = np.searchsorted(doc_ends, begin, side="right")
                window = np.searchsorted(cuts, begin, side="right") - 1
                doc_begins = np.insert(doc_ends[:-1], 0, 0)
                raw = memoryview(ids.tobytes())
                out = pd.DataFrame(
                    {
                        "doc_id": doc_ids[a:b][doc],
                        "start": begin - doc_begins[doc],
                        "length": end - begin,
                        "ids_crc32": [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begin.tolist(), end.tolist())],
                        "doc_tokens": (doc_ends - doc_begins)[doc],
                        "sequence_id": sequence + window,
                        "offset": begin - cuts[window],
                    }
                )
                if with_ids:
                    out["ids"] = [ids[x:y].astype(np.int64) for x, y in zip(begin.tolist(), end.tolist())]
                sequence += len(cuts) - 1
                yield out

    return ids_restored(ids_as_text(docs, id_col, F.col(text_col).alias("text")).mapInPandas(run, schema), docs, id_col)
