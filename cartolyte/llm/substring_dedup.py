"""Substring dedup on a compacted de Bruijn graph of token k-mers.

A window is ``WINDOW`` consecutive words of one document. A word is removed if a window that covers it has a word
sequence that also starts earlier (smaller document, or the same document and an earlier start).

Graph. Nodes are anchors: of the ``WINDOW - K + 1`` k-mers in a window, the one of least hash. Equal windows have equal
anchors, and about one word in seven starts one. An edge joins an anchor to the document's next one and carries the
hash of the words it spans. Only anchors that occur twice can lie in a repeated window, so the others leave at once.

Compaction. An anchor all of whose occurrences leave by the same edge, followed by one that all of its occurrences
enter by the same edge, forms an unbranched step; each document's runs of such steps are its paths. All occurrences of
a window inside a path lie inside the occurrences of that path, so one row for a path stands for all its windows.
Windows that touch a repeated anchor but lie in no path get a row each.

Verification. Rows of paths and windows carry source coordinates and a digest of the words that stand there, read from the
text: 128 bits of BLAKE2b over the words as they are, so equal digests are equal words, also where somebody would have
them differ. The first of equal rows stays; each other row removes its words. A text is read to find anchors, to digest
paths and windows, and to drop words; for the last two it is joined with its own lists, so it is shuffled twice. The
64-bit hashes of anchors and edges only decide which rows are made: a clash makes rows that digests then tell apart.

Skew: counts and first places are formed map-side before they are shuffled; the two joins on an anchor have plain
exchanges on both sides, which Spark splits where an anchor has many rows. What is gathered per document is in
proportion to its own length.

Defined cases: a null text has no words; texts under ``WINDOW`` words lose nothing; rows of one doc_id and equal
texts are one document, of other texts several, null ids before all others; an empty table gives an empty result; other columns are ignored by
:func:`substring_dedup` and kept by :func:`cut_repeats`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolyte.llm.common import bounded_batches, written
from cartolyte.llm.pretokens import _mix, blocks, gather
from cartolyte.llm.words import run_hashes, split_words, text_of

WINDOW = 20
#: Words of an anchor.
K = 8
_SPACES = re.compile("[\x20\x09-\x0d]+")
_EVEN = np.uint64(0xD6E8FEB86659FD93)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _prefixes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums that give the hash of any span: (sums, powers), modulo 2**64."""
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(hashes), _EVEN)]))
        sums = np.concatenate([[np.uint64(0)], np.add.accumulate(hashes * powers[1:])])
    return sums, powers


def _inverse_powers(n: int) -> np.ndarray:
    inverse = np.uint64(pow(int(_EVEN), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))


class _Spans:
    """Hashes of spans of words by their content alone."""

    def __init__(self, hashes: np.ndarray):
        self.sums, _ = _prefixes(hashes)
        self.back = _inverse_powers(len(hashes))

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix(((self.sums[end] - self.sums[begin]) * self.back[begin]) ^ _mix((end - begin).astype(np.uint64)))


def anchor_positions(kmers: np.ndarray, first: np.ndarray, window: int, k: int) -> np.ndarray:
    """Word positions of the anchors of all windows that lie within one text."""
    width = window - k + 1
    n = len(kmers) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    inside = np.zeros(n + 1, bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= window:
            inside[a : b - window + 1] = True
    starts = np.flatnonzero(inside[:n])
    if not len(starts):
        return starts
    view = np.lib.stride_tricks.sliding_window_view(kmers, width)
    return np.unique(starts + view[starts].argmin(axis=1))


def _anchors(docs: DataFrame, window: int, k: int, full: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            texts, ids = frame["text"].fillna("").tolist(), frame["doc_id"].to_numpy()
            for a, b in blocks(texts):
                w = split_words(texts[a:b])
                kmers = run_hashes(w.hashes, k)
                at = anchor_positions(kmers, w.first, window, k)
                if not full:
                    yield pd.DataFrame({"h": _signed(np.unique(kmers[at]))})
                    yield pd.DataFrame({"h": _signed(_repeated(kmers[at]))})
                    continue
                doc = np.searchsorted(w.first, at, side="right") - 1
                spans = _Spans(w.hashes)
                link = np.zeros(len(at) + 1, np.uint64)  # link[i]: from anchor i - 1 to anchor i; 0 at a text's ends
                if len(at) > 1:
                    same = doc[1:] == doc[:-1]
                    link[1:-1] = np.where(same, spans.hash(at[:-1], at[1:] + k) | np.uint64(1), np.uint64(0))
                yield pd.DataFrame({"h": _signed(kmers[at]), "doc_id": ids[a:b][doc], "pos": (at - w.first[doc]).astype(np.int32), "pred": _signed(link[:-1]), "succ": _signed(link[1:])})

    return docs.select("doc_id", "text").mapInPandas(run, f"h long, doc_id {kind}, pos int, pred long, succ long" if full else "h long")


def _repeated(x: np.ndarray) -> np.ndarray:
    values, counts = np.unique(x, return_counts=True)
    return values[counts > 1]


def _rows(w, starts: list[np.ndarray], fresh: list[np.ndarray], window: int, k: int):
    """Paths and single windows of a block of texts: (doc, begin, end) of the rows, begin and end within the block's words."""
    doc_p, begin_p, end_p, doc_s, at_s = [], [], [], [], []
    for d, (pos, new) in enumerate(zip(starts, fresh)):
        base, n = int(w.first[d]), int(w.first[d + 1] - w.first[d])
        if not len(pos):
            continue
        heads = np.flatnonzero(new)
        begin, end = pos[heads], pos[np.append(heads[1:], len(pos)) - 1] + k
        long = end - begin >= window
        begin, end = begin[long], end[long]
        marks = np.zeros(n + 2, np.int32)
        np.add.at(marks, np.maximum(pos - (window - k), 0), 1)
        np.add.at(marks, np.minimum(pos, n - window) + 1, -1)
        touched = np.cumsum(marks)[:n] > 0
        marks[:] = 0
        np.add.at(marks, begin, 1)
        np.add.at(marks, end - window + 1, -1)
        touched &= np.cumsum(marks)[:n] == 0
        single = np.flatnonzero(touched[: max(n - window + 1, 0)])
        doc_p.append(np.full(len(begin), d)), begin_p.append(begin + base), end_p.append(end + base)
        doc_s.append(np.full(len(single), d)), at_s.append(single + base)
    cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    at = cat(at_s)
    return np.concatenate([cat(doc_p), cat(doc_s)]), np.concatenate([cat(begin_p), at]), np.concatenate([cat(end_p), at + window])


def _lists(frame: pd.DataFrame, name: str) -> list[np.ndarray]:
    return [np.zeros(0, np.int64) if x is None else np.asarray(x) for x in frame[name]]


def digests(w, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two signed 64-bit halves of the digest of the words from ``begin`` to ``end``, each word followed by one blank."""
    sizes = w.ends - w.begins + 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    letters = w.points[gather(w.begins, sizes)]
    letters[first[1:] - 1] = 32
    raw, blake = memoryview(letters.tobytes()), hashlib.blake2b
    found = b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip((4 * first[begin]).tolist(), (4 * first[end]).tolist())])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def _keyed(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(k1, k2, doc_id, start): a row for each path and each single window."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            texts, ids, pos, new = frame["text"].fillna("").tolist(), frame["doc_id"].to_numpy(), _lists(frame, "pos"), _lists(frame, "fresh")
            for a, b in blocks(texts):
                w = split_words(texts[a:b])
                doc, begin, end = _rows(w, pos[a:b], new[a:b], window, k)
                keys = digests(w, begin, end)
                yield pd.DataFrame({"k1": keys[:, 0], "k2": keys[:, 1], "doc_id": ids[a:b][doc], "start": (begin - w.first[doc]).astype(np.int32)})

    return docs.mapInPandas(run, f"k1 long, k2 long, doc_id {kind}, start int")


def graph(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, pos, fresh): each document's repeated anchors in order, and where a path starts anew."""
    twice = _anchors(docs, window, k, full=False).groupBy("h").count().where("count > 1").select("h")
    twice = written(twice, "anchors-twice")
    nodes = written(_anchors(docs, window, k, full=True).join(twice.hint("shuffle_merge"), "h", "left_semi"), "anchors")
    same = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    branches = written(nodes.groupBy("h").agg(same("pred").alias("one_in"), same("succ").alias("one_out")), "branches")
    steps = nodes.join(branches.hint("shuffle_merge"), "h")
    in_order = Window.partitionBy("doc_id").orderBy("pos")
    joined = F.col("one_in") & F.lag("one_out").over(in_order) & (F.lag("succ").over(in_order) == F.col("pred"))
    steps = steps.select("doc_id", "pos", (~F.coalesce(joined, F.lit(False))).alias("fresh"))
    lists = steps.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "fresh"))).alias("l"))
    return written(lists.select("doc_id", F.col("l.pos").alias("pos"), F.col("l.fresh").alias("fresh")), "paths")


def marked(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, pos, fresh, firsts): the graph's lists and the starts of each document's rows that stay."""
    paths = graph(docs, window, k)
    rows = _keyed(docs.select("doc_id", "text").join(paths, "doc_id"), window, k)
    firsts = rows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "start")).alias("at"))
    kept = firsts.select("at.doc_id", "at.start").groupBy("doc_id").agg(F.collect_list("start").alias("firsts"))
    return written(paths.join(kept, "doc_id", "left"), "firsts")


def removed_words(w, pos: list[np.ndarray], fresh: list[np.ndarray], firsts: list[np.ndarray], window: int, k: int) -> np.ndarray:
    """A flag for each word of the block: it is removed."""
    doc, begin, end = _rows(w, pos, fresh, window, k)
    n = len(w.hashes)
    stays = np.zeros(n + 1, bool)
    for d, s in enumerate(firsts):
        stays[s + w.first[d]] = True
    gone = ~stays[begin]
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, begin[gone], 1)
    np.add.at(marks, end[gone], -1)
    return np.cumsum(marks)[:n] > 0


def _apply(docs: DataFrame, window: int, k: int, schema: str, make) -> DataFrame:
    bounded_batches(docs)
    columns = docs.columns
    own = [f"_{n}" for n in range(len(columns))]  # names that can't clash
    plain = docs.toDF(*own)
    id_at, text_at = own[columns.index("doc_id")], own[columns.index("text")]
    keyed = plain.withColumn("_key", F.col(id_at))
    texts = keyed
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        # Ids that say too little: number the distinct (id, text) pairs in their order and go by that.
        pair = (F.col(id_at).alias("i"), F.xxhash64(text_at).alias("t"))
        pairs = written(plain.select(*pair).distinct().orderBy("i", "t").withColumn("_key", F.monotonically_increasing_id()), "pairs")
        keyed = plain.join(pairs, F.col(id_at).eqNullSafe(F.col("i")) & (F.xxhash64(text_at) == F.col("t"))).drop("i", "t")
        texts = keyed.dropDuplicates(["_key"])
    marks = marked(texts.select(F.col("_key").alias("doc_id"), F.col(text_at).alias("text")), window, k)
    joined = keyed.join(marks, keyed["_key"] == marks["doc_id"], "left").drop("doc_id", "_key")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_at)).to_pylist()]
            pos, fresh, firsts = (_arrow_lists(batch.column(batch.schema.get_field_index(c))) for c in ("pos", "fresh", "firsts"))
            own_columns = batch.select(own).rename_columns(columns)
            for a, b in blocks(texts):
                kept, n_words, n_removed = [], [], []
                touched = [i for i in range(a, b) if len(pos[i])]
                w = split_words([texts[i] for i in touched])
                gone = removed_words(w, [pos[i] for i in touched], [fresh[i] for i in touched], [firsts[i] for i in touched], window, k)
                at = dict(zip(touched, range(len(touched))))
                for i in range(a, b):
                    words = _SPACES.split(texts[i].strip("\x20\x09\x0a\x0b\x0c\x0d"))
                    words = [] if words == [""] else words
                    n_words.append(len(words))
                    if i in at:
                        lost = gone[w.first[at[i]] : w.first[at[i] + 1]]
                        if lost.any():
                            words = [x for x, l in zip(words, lost.tolist()) if not l]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(" ".join(words))
                yield make(own_columns.slice(a, b - a), kept, n_words, n_removed)

    return joined.mapInArrow(run, schema)


def _arrow_lists(column: pa.ListArray) -> list[np.ndarray]:
    values, ends, valid = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_valid().to_pylist()
    return [values[a:b] if v else values[:0] for a, b, v in zip(ends[:-1], ends[1:], valid)]


def substring_dedup(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batch, kept, n_words, n_removed):
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in kept]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _apply(docs.select("doc_id", "text"), window, k, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string", make)


def cut_repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The documents with their columns; a text that loses words becomes its kept words joined by one space."""
    at = docs.columns.index("text")

    def make(batch, kept, n_words, n_removed):
        text = [new if lost else old for new, lost, old in zip(kept, n_removed, batch.column(at).to_pylist())]
        return batch.set_column(at, batch.schema.field(at), pa.array(text, batch.schema.field(at).type))

    return _apply(docs, window, k, docs.schema, make)
