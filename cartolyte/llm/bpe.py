"""Byte-level BPE encoding by merge replay over distinct words, and decoding.

The corpus' texts become distinct pretokens. For a block of those, an inverted index leads from the rank of a token
pair to the word positions that hold it; merges are applied in rank order, each touching only the two neighbours of
the places where it applies. Words don't influence each other, so any split of the distinct words over tasks replays
the same merges: each Spark task does so for the words of its own documents, block by block, and keeps a bounded table
of the words it has met. Nothing is shuffled, and the vocabulary's merge table has a fixed size.

Defined cases: a null text counts as empty and has no ids; any text, also of control characters, round-trips to its
UTF-8 bytes; repeated rows are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolyte.llm.common import ids_as_text, ids_restored
from cartolyte.llm.pretokens import WordTable, blocks, encode_texts


class MergeTable:
    """A rank file: the bytes of each token, and the rank of each pair of tokens that together are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.width = max(self.ranks.values()) + 1
        self.pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    self.pairs[a * self.width + b] = rank
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)


def replay(words: list[bytes], merges: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, flat, and the number of ids of each."""
    whole = [merges.ranks.get(w) for w in words]
    rest = [w for w, r in zip(words, whole) if r is None and w]
    flat, count = _replay_parts(rest, merges) if rest else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    counts = np.ones(len(words), np.int64)
    is_rest = np.fromiter((r is None and bool(w) for w, r in zip(words, whole)), bool, len(words))
    counts[is_rest] = count
    counts[np.fromiter((not w for w in words), bool, len(words))] = 0
    out = np.empty(int(counts.sum()), np.int64)
    owner = np.repeat(is_rest, counts)
    out[owner] = flat
    out[~owner] = [r for r in whole if r is not None]
    return out, counts


def _replay_parts(words: list[bytes], merges: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    pairs, width = merges.pairs, merges.width
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    symbols = merges.single[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbols)
    after = np.arange(1, n + 1)
    after[ends - 1] = -1
    before = np.arange(-1, n - 1)
    before[ends - lengths] = -1

    # The inverted index at the start: rank of the pair -> positions of its left symbol, ascending.
    keys = symbols[:-1] * width + symbols[1:]
    keys[ends[:-1] - 1] = -1
    distinct, codes = np.unique(keys, return_inverse=True)
    rank_of = np.fromiter((pairs.get(k, -1) for k in distinct.tolist()), np.int64, len(distinct))[codes] if n > 1 else np.zeros(0, np.int64)
    held = np.flatnonzero(rank_of >= 0)
    held = held[np.argsort(rank_of[held], kind="stable")]
    ranks, firsts = np.unique(rank_of[held], return_index=True)
    index = {r: p.tolist() for r, p in zip(ranks.tolist(), np.split(held, firsts[1:]))} if len(held) else {}
    queue = list(index)
    heapify(queue)

    tok, nxt, prv, get = symbols.tolist(), after.tolist(), before.tolist(), pairs.get
    while queue:
        rank = heappop(queue)
        places = index.pop(rank)
        places.sort()
        for done, i in enumerate(places):
            j = nxt[i]
            left = tok[i]
            if left < 0 or j < 0 or get(left * width + tok[j]) != rank:
                continue
            tok[i], tok[j] = rank, -1
            k = nxt[i] = nxt[j]
            lower = False
            if k >= 0:
                prv[k] = i
                if (r := get(rank * width + tok[k])) is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        heappush(queue, r)
                    lower = r <= rank
            p = prv[i]
            if p >= 0 and (r := get(tok[p] * width + rank)) is not None:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heappush(queue, r)
                lower |= r <= rank
            if lower:  # a pair of lower rank came up, which goes first
                if later := places[done + 1 :]:
                    if rank in index:
                        index[rank] += later
                    else:
                        index[rank] = later
                        heappush(queue, rank)
                break
    out = np.array(tok, np.int64)
    alive = out >= 0
    return out[alive], np.add.reduceat(alive.astype(np.int64), ends - lengths)


@lru_cache(2)
def _merges(path: str) -> MergeTable:
    return MergeTable(path)


@lru_cache(1)
def _words(path: str) -> WordTable:
    merges = _merges(path)
    return WordTable(lambda words: replay(words, merges))


def _encoded(frames: Iterator[pd.DataFrame], path: str) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    words = _words(path)
    for frame in frames:
        texts = frame["text"].fillna("").tolist()
        for a, b in blocks(texts):
            flat, counts = encode_texts(texts[a:b], words)
            yield frame.iloc[a:b], np.split(flat, np.cumsum(counts)[:-1])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text."""
    def run(frames):
        for frame, ids in _encoded(frames, path):
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "ids": ids})

    return ids_restored(ids_as_text(docs, id_col, F.col(text_col).alias("text")).mapInPandas(run, "doc_id string, ids array<int>"), docs, id_col)


def decode_ids(ids: np.ndarray, merges: MergeTable) -> bytes:
    return b"".join(map(merges.bytes_of.__getitem__, ids.tolist()))


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the bytes that the ids stand for; null ids give no bytes."""
    def run(frames):
        merges = _merges(path)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "bytes": [b"" if x is None else decode_ids(np.asarray(x), merges) for x in frame["ids"]]})

    return ids_restored(ids_as_text(tokens, id_col, F.col(ids_col).alias("ids")).mapInPandas(run, "doc_id string, bytes binary"), tokens, id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode in the same task: (doc_id, n_tokens, ids_sha256, decoded_sha256), without moving the ids."""
    def run(frames):
        merges = _merges(path)
        decimal = np.array([b"%d" % i for i in range(merges.width)], object)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for frame, ids in _encoded(frames, path):
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].to_numpy(),
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [sha(b",".join(decimal[x].tolist())) for x in ids],
                    "decoded_sha256": [sha(decode_ids(x, merges)) for x in ids],
                }
            )

    out = ids_as_text(docs, id_col, F.col(text_col).alias("text")).mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return ids_restored(out, docs, id_col)
