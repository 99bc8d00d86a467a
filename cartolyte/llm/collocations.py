"""Phrase collocations: word n-grams that keep together more often than their parts would by chance.

Two passes over the texts, each with one task a core. The first counts all n-grams in count-min sketches, one a task,
whose cells stop at ``least_count``; they are cut into slices and merged slice by slice, first those of neighbouring
tasks, then all. A sketch never counts too few, so an n-gram below ``least_count`` in one of its cells is rare for certain. The second pass
keeps the occurrences whose cells, and those of all n-grams inside them, reach it, and counts exactly these: by 128-bit
hashes inside a task, by their words across tasks. What is rare after that goes; nothing frequent was lost. Candidates
are then scored at each cut by joins with their parts' counts, and those inside an equally frequent longer one go.

Size: the sketch has two rows of a width that the corpus sets (about three n-grams a cell for each ten of
``least_count``, at most ``WIDTHS[1]`` cells of one byte). Merged, only the bits of cells that reach ``least_count`` are
collected and broadcast, 16 MB at most. Sketches number as the cores do, not as the input's splits, so what moves grows
with the width alone. Beyond the greatest width, cells fill up and the second pass keeps more occurrences; results stay
the same. With ``least_count`` raised along with the corpus, the width stays as it is.

Bounds and skew: a text is cut into blocks of bounded bytes; the last words of a block come again before the next,
so that no n-gram is lost or counted twice. Counts are combined in each task before they move. Joins are plain
exchanges, which Spark splits where a part (a very common word) has many candidates.

Defined cases: a null text is empty; a null lang is ``und``; repeated rows count each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolyte.llm.common import bounded_batches, drop_written, text_or_empty, written
from cartolyte.llm.pretokens import _mix

#: Words of the longest phrase, occurrences of a candidate, percentage of a longer one that makes it superfluous, and phrases of each language.
LONGEST, LEAST_COUNT, SHARE, RANKS = 5, 100, 100, 2000
#: Least and most cells of a sketch's row, cells of a slice, tasks whose slices are merged first, and bytes of a block.
WIDTHS, SLICE, TASKS, BLOCK = (1 << 16, 1 << 26), 1 << 18, 32, 1 << 21
#: Rows of counts that a task holds before it combines them.
HELD = 1_000_000

_WORD, _BLANK, _BREAK = 0, 1, 2
_KINDS = np.full(256, _WORD, np.uint8)
_KINDS[[0x09, 0x20]] = _BLANK
_KINDS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = [_mix(np.arange(256, dtype=np.uint64) + np.uint64(seed)) for seed in (1 << 20, 2 << 20)]
_FACTORS = [_mix(np.arange(LONGEST, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1) for seed in (3 << 20, 4 << 20)]
_SECOND_ROW = np.uint64(0x9E3779B97F4A7C15)


class Block(NamedTuple):
    """The words of a run of texts: lower-cased bytes, each word's begin and end there, its piece, whether it is new, and its language's number."""

    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    new: np.ndarray
    lang: np.ndarray

    def hashes(self, which: int) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.begins):
            return np.zeros(0, np.uint64)
        within = np.arange(len(self.data), dtype=np.int64)
        starts = np.concatenate([[0], self.begins])
        within -= np.repeat(starts, np.diff(np.concatenate([starts, [len(self.data)]])))
        values = _BYTES[which][self.data]
        with np.errstate(over="ignore"):
            values *= _mix(within.astype(np.uint64)) | np.uint64(1)
            values[_KINDS[self.data] != _WORD] = 0
            return _mix(np.add.reduceat(values, self.begins) ^ _mix((self.ends - self.begins).astype(np.uint64)))

    def runs(self, n: int) -> np.ndarray:
        """Which words begin a run of n words of one piece that ends in a new word."""
        m = len(self.begins) - n + 1
        if m <= 0:
            return np.zeros(0, bool)
        return (self.piece[:m] == self.piece[n - 1 :]) & self.new[n - 1 :]


def run_hashes(words: np.ndarray, n: int, which: int, langs: np.ndarray) -> np.ndarray:
    """The hash of each run of n words in its language."""
    m = max(len(words) - n + 1, 0)
    with np.errstate(over="ignore"):
        out = langs[:m] + np.uint64(n)
        for j in range(n):
            out = out + words[j : j + m] * _FACTORS[which][j]
        return _mix(out)


def _cut(data: bytes) -> Iterator[tuple[bytes, int]]:
    """A long text in parts that begin with the last words of the part before; how many bytes of a part are such."""
    at, before = 0, 0
    while len(data) - at > BLOCK:
        end = at + BLOCK
        while end < len(data) and _KINDS[data[end]] == _WORD:
            end += 1
        yield data[before:end], at - before
        # Back over LONGEST - 1 words, or to the end of the piece that they lie in.
        back, words = end, 0
        while back > before and words < LONGEST - 1 and _KINDS[data[back - 1]] != _BREAK:
            while back > before and _KINDS[data[back - 1]] == _BLANK:
                back -= 1
            had = back
            while back > before and _KINDS[data[back - 1]] == _WORD:
                back -= 1
            words += back < had
        at, before = end, back
    yield data[before:], at - before


def blocks_of(batch: pa.RecordBatch, langs: dict[str, int]) -> Iterator[Block]:
    """The blocks of a batch of (lang, text as bytes); ``langs`` numbers the languages as they come."""
    parts, old, numbers, size = [], [], [], 0
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
        number = langs.setdefault(lang, len(langs))
        for part, again in _cut(text.as_py()):
            if size and size + len(part) > 2 * BLOCK:
                yield _block(parts, old, numbers)
                parts, old, numbers, size = [], [], [], 0
            parts.append(part)
            old.append(again)
            numbers.append(number)
            size += len(part) + 1
    if parts:
        yield _block(parts, old, numbers)


def _block(parts: list[bytes], old: list[int], numbers: list[int]) -> Block:
    data = _LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    kinds = _KINDS[data]
    word = kinds == _WORD
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    begins, ends = edge[::2], edge[1::2]
    piece = np.cumsum(kinds == _BREAK, dtype=np.int32)[begins]
    lens = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    starts = np.cumsum(lens) - lens
    part = np.searchsorted(starts, begins, side="right") - 1
    return Block(data, begins, ends, piece, begins >= (starts + np.array(old, np.int64))[part], np.array(numbers, np.int64)[part])


def _lang_hash(langs: dict[str, int]) -> np.ndarray:
    """A hash of each numbered language, the same in all tasks."""
    return np.array([int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little") for lang in langs], np.uint64)


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes if row == 0 else hashes * _SECOND_ROW) >> np.uint64(64 - bits)).astype(np.uint32)


def _sketching(bits: int, longest: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, langs, seen = np.zeros((2, 1 << bits), np.uint8), {}, False
        for batch in batches:
            for block in blocks_of(batch, langs):
                words, lang = block.hashes(0), _lang_hash(langs)[block.lang]
                hashes = [run_hashes(words, n, 0, lang)[block.runs(n)] for n in range(1, longest + 1)]
                seen = seen or len(hashes[0]) > 0
                hashes = np.concatenate(hashes)
                for k in range(2):
                    cells = np.sort(_cells(hashes, k, bits))
                    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
                    counts, cells = np.diff(np.append(first, len(cells))), cells[first]
                    rows[k, cells] = np.minimum(rows[k, cells] + np.minimum(counts, least), least)
        if seen:
            task = TaskContext.get().partitionId()
            for k in range(2):
                for i in range(0, 1 << bits, SLICE):
                    data = zlib.compress(rows[k, i : i + SLICE].tobytes(), 1)
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([k * ((1 << bits) // min(SLICE, 1 << bits)) + i // SLICE], pa.int32()), "task": pa.array([task // TASKS], pa.int32()), "cells": pa.array([data], pa.binary())})

    return run


_SLICES = "slice int, task int, cells binary"


def _merging(least: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only the slices of this task are held, whatever the number of sketches.
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for key in zip(batch["slice"].to_pylist(), batch["task"].to_pylist(), batch["cells"]):
                cells = np.frombuffer(zlib.decompress(key[2].as_py()), np.uint8)
                held = sums.get(key[:2])
                sums[key[:2]] = cells.copy() if held is None else np.minimum(held.astype(np.uint16) + cells, least).astype(np.uint8)
        for (number, _), cells in sums.items():
            data = zlib.compress((np.packbits(cells >= least, bitorder="little") if last else cells).tobytes(), 1)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int32()), "task": pa.array([0], pa.int32()), "cells": pa.array([data], pa.binary())})

    return run


def _inputs(docs: DataFrame) -> DataFrame:
    """(lang, text as bytes), with as many partitions as the cluster has cores, at most."""
    bounded_batches(docs)
    return docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty("text").cast("binary").alias("text"))


def sketch(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT) -> tuple[int, list]:
    """The bits of a row's width, and (slice, compressed bits) of the merged sketch: which cells reach ``least``."""
    if not 1 < least <= 255:
        raise ValueError("least_count has to lie between 2 and 255, as cells are bytes")
    if not 1 < longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words at most")
    size = docs.agg(F.sum(F.octet_length(text_or_empty("text")))).first()[0] or 0
    # Six bytes a word, about; that is a choice of width, not of what is counted.
    wanted = max(size * longest / 6 / (0.3 * least), 1)
    bits = int(np.clip(np.ceil(np.log2(wanted)), np.log2(WIDTHS[0]), np.log2(WIDTHS[1])))
    slices = written(_inputs(docs).mapInArrow(_sketching(bits, longest, least), _SLICES), "sketches")
    near = slices.repartition("slice", "task").mapInArrow(_merging(least, False), _SLICES)
    merged = near.repartition("slice").mapInArrow(_merging(least, True), _SLICES).select("slice", "cells").collect()
    drop_written(slices)
    return bits, [(r["slice"], bytes(r["cells"])) for r in merged]


class _Counts:
    """Exact counts of the phrases that a task keeps, by two hashes."""

    def __init__(self) -> None:
        self.hashes, self.counts, self.langs, self.texts, self.held = [], [], [], [], 0

    def add(self, block: Block, at: np.ndarray, n: int, first: np.ndarray, second: np.ndarray) -> None:
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
        at = at[order[starts]]
        self.hashes.append(np.stack([first[starts], second[starts]]))
        self.counts.append(np.diff(np.append(starts, len(first))))
        self.langs.append(block.lang[at])
        data = block.data.tobytes()
        # Blanks between words become one space each; other white space ends a piece.
        texts = [b" ".join(data[a:b].split()) for a, b in zip(block.begins[at].tolist(), block.ends[at + n - 1].tolist())]
        self.texts.append(pa.array(texts, pa.binary()))
        self.held += len(at)

    def combine(self) -> None:
        if len(self.counts) < 2:
            return
        hashes, counts, langs = np.concatenate(self.hashes, axis=1), np.concatenate(self.counts), np.concatenate(self.langs)
        order = np.lexsort((hashes[1], hashes[0]))
        hashes = hashes[:, order]
        starts = np.flatnonzero(np.concatenate([[True], (hashes[:, 1:] != hashes[:, :-1]).any(axis=0)]))
        self.hashes, self.counts, self.langs = [hashes[:, starts]], [np.add.reduceat(counts[order], starts)], [langs[order[starts]]]
        self.texts = [pa.chunked_array(self.texts).take(pa.array(order[starts])).combine_chunks()]
        self.held = len(starts)

    def rows(self, names: list[str], words: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(lang, n, phrase, f), and an empty phrase with the words of each language."""
        self.combine()
        if self.counts:
            langs = pa.array(names, pa.string()).take(pa.array(self.langs[0]))
            text = self.texts[0] if isinstance(self.texts[0], pa.Array) else self.texts[0].combine_chunks()
            for i in range(0, len(langs), 100_000):
                yield pa.RecordBatch.from_arrays([langs[i : i + 100_000], text[i : i + 100_000].cast(pa.string()), pa.array(self.counts[0][i : i + 100_000], pa.int64())], names=["lang", "phrase", "f"])
        if len(names):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([""] * len(names), pa.string()), pa.array(words, pa.int64())], names=["lang", "phrase", "f"])
        self.__init__()


def _counting(bits: int, shared, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, langs, counts, words = np.zeros(2 << bits >> 3, np.uint8), {}, _Counts(), np.zeros(0, np.int64)
        for number, cells in shared.value:
            part = np.frombuffer(zlib.decompress(cells), np.uint8)
            often[number * len(part) : (number + 1) * len(part)] = part
        often = often.reshape(2, -1)
        for batch in batches:
            for block in blocks_of(batch, langs):
                words = np.concatenate([words, np.zeros(len(langs) - len(words), np.int64)]) + np.bincount(block.lang[block.new], minlength=len(langs))
                lang = _lang_hash(langs)[block.lang]
                first, second = block.hashes(0), block.hashes(1)
                kept = np.ones(len(first), bool)
                for n in range(1, longest + 1):
                    m = len(first) - n + 1
                    if m <= 0:
                        break
                    # Both runs inside have to be frequent; those in words that came before are judged anew.
                    inside = kept[:m] if n == 1 else kept[:m] & kept[1 : m + 1]
                    at = np.flatnonzero(inside & (block.piece[:m] == block.piece[n - 1 :]))
                    own = np.zeros(m, bool)
                    if len(at):
                        h = _runs_at(first, at, n, 0, lang)
                        for k in range(2):
                            cell = _cells(h, k, bits)
                            reach = (often[k][cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                            at, h = at[reach], h[reach]
                        own[at] = True
                        new = block.new[at + n - 1]
                        at, h = at[new], h[new]
                        if len(at):
                            counts.add(block, at, n, h, _runs_at(second, at, n, 1, lang))
                    kept = own
            if counts.held >= HELD:
                counts.combine()
                if counts.held >= HELD // 2:
                    yield from counts.rows(list(langs), words)
                    words[:] = 0
        yield from counts.rows(list(langs), words)

    return run


def _runs_at(words: np.ndarray, at: np.ndarray, n: int, which: int, langs: np.ndarray) -> np.ndarray:
    """The hashes of the runs of n words that begin at the given ones."""
    with np.errstate(over="ignore"):
        out = langs[at] + np.uint64(n)
        for j in range(n):
            out += words[at + j] * _FACTORS[which][j]
        return _mix(out)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT) -> DataFrame:
    """(lang, phrase, f): all runs of up to ``longest`` words with at least ``least`` occurrences, exactly; an empty phrase has all words of a language."""
    bits, merged = sketch(docs, longest, least)
    shared = docs.sparkSession.sparkContext.broadcast(merged)
    kept = _inputs(docs).mapInArrow(_counting(bits, shared, longest), "lang string, phrase string, f long")
    return kept.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def _whole(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, share: int = SHARE, ranks: int = RANKS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language."""
    found = written(frequent_phrases(docs, longest, least), "phrases")
    sizes = found.where("phrase = ''").select("lang", F.col("f").alias("n"))
    counts = found.where("phrase <> ''")
    candidates = counts.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1).withColumnRenamed("f", "a")

    part = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_l"), part(F.col("k") + 1, F.size("words")).alias("_r"))
    named = lambda key, f: counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(f))
    met = cuts.join(named("_l", "l"), ["lang", "_l"]).join(named("_r", "r"), ["lang", "_r"]).join(sizes, "lang")
    score = F.call_function("div", _whole(F.col("a")) * _whole(F.col("n")) * F.lit(1000).cast("decimal(4,0)"), _whole(F.col("l")) * _whole(F.col("r")))
    scored = met.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("s"))

    # Every shorter run of two words or more inside a candidate, with the candidate's count.
    lens = F.sequence(F.lit(2), F.size("words") - 1)
    inner = F.flatten(F.transform(lens, lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longer = candidates.where(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("_longer")).groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    kept = scored.select("lang", "phrase", "s.*").join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= ranks).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
