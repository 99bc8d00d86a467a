"""How the sources of each language differ in their words: source against source, and the words that set a source apart.

Every partition of the documents counts its terms in one radix trie over bytes for each language, whose leaves have a
counter for each source. A trie is read in byte order, which is the order of UTF-8, into rows of leaves, and a new one
begun, whenever the tries have ``LEAVES`` leaves. The leaves of all tries are partitioned by ranges of (language, term),
that is by ranges of prefixes, and sorted; a task merges its range as it streams by, as equal leaves follow each other.
Terms in enough documents stay, in byte order. These are streamed once for the pairs of sources, into one matrix of sums
a language, and once for the candidate terms of each source, of which Spark keeps the first ranks in each task before they move.

Bounds and skew: a task holds tries of bounded leaves with their counters; of a range a batch and one leaf; for the pairs
a block of terms and the sums of one language's pairs of sources, which are as many as the result has rows. A term that
every document holds comes as one row from each trie. A language with most of the rows is spread over many ranges.

Defined cases: null text, lang and source count as empty strings; every row counts as a document, repeated ones too; a
group without kept terms has pairs of value 0 if its language keeps none, and no terms; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolyte.llm.common import bounded_batches, drop_written, text_or_empty, written

#: Documents of a language that have to hold a term, the smoothing of counts, and the candidates of each source.
LEAST_DOCS, SMOOTHING, RANKS = 30, 5, 50
#: Shares are whole billionths.
SCALE = 1_000_000_000
#: Leaves of a task's tries, counts that it holds before it adds them up, bytes of a text that are split at once, and cells of a block of terms by sources.
LEAVES, HELD, PIECE, CELLS = 400_000, 1_000_000, 1 << 22, 1 << 21
#: Terms after lower-casing A-Z in UTF-8: runs of letters and of everything beyond ASCII.
_TERM, _GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")


class Trie:
    """A radix trie over bytes whose leaves are numbers. A node is [edge, children by first byte or None, leaf or -1]."""

    def __init__(self) -> None:
        self.root: list = [b"", None, -1]
        self.leaves = 0

    def insert(self, terms: list[tuple[bytes, int]]) -> None:
        """New terms in byte order, with their numbers: each starts at the last node that it shares with the one before."""
        path, before = [(self.root, 0)], b""
        for term, number in terms:
            shared, most = 0, min(len(term), len(before))
            while shared < most and term[shared] == before[shared]:
                shared += 1
            while path[-1][1] > shared:
                path.pop()
            node, at = path[-1]
            while at < len(term):
                child = node[1].get(term[at]) if node[1] else None
                if child is None:
                    child = [term[at:], None, -1]
                    if node[1] is None:
                        node[1] = {}
                    node[1][term[at]] = child
                    node, at = child, len(term)
                elif term.startswith(child[0], at):
                    node, at = child, at + len(child[0])
                else:
                    edge, k = child[0], 1
                    while at + k < len(term) and edge[k] == term[at + k]:
                        k += 1
                    upper = [edge[:k], {edge[k]: child}, -1]
                    child[0], node[1][term[at]] = edge[k:], upper
                    node, at = upper, at + k
                path.append((node, at))
            node[2] = number
            self.leaves += 1
            before = term

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """The terms and their numbers in byte order."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            term = prefix + node[0]
            if node[2] >= 0:
                yield term, node[2]
            if node[1]:
                stack.extend((term, node[1][first]) for first in sorted(node[1], reverse=True))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded size; a long text is cut between terms."""
    at, text = 0, text.lower()
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        if gap is None:
            break
        yield _TERM.findall(text, at, gap.start())
        at = gap.start()
    yield _TERM.findall(text, at)


_LEAF = "lang string, term string, docs long, counts array<struct<source:string,n:long>>"
_COUNTS = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
_LEAF_ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("counts", _COUNTS)])


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(keys) else values


def _lists(owners: np.ndarray, n_owners: int, sources: pa.Array, n: np.ndarray) -> pa.Array:
    """The counts of each owner as a list; owners are in order."""
    offsets = np.searchsorted(owners, np.arange(n_owners + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([sources, pa.array(n, pa.int64())], fields=list(_COUNTS.value_type)))


class _Tally:
    """The trie of a language, and the counters of its leaves: occurrences by source, and documents."""

    def __init__(self) -> None:
        self.trie = Trie()
        self.known: dict[bytes, int] = defaultdict(count().__next__)  # the terms' numbers, in the order of their coming
        self.sources: dict[str, int] = {}
        self.keys, self.n, self.docs, self.held = [], [], np.zeros(0, np.int64), 0

    def add(self, source: str, text: bytes) -> None:
        parts = [np.fromiter(map(self.known.__getitem__, terms), np.int64, len(terms)) for terms in terms_of(text)]
        found, n = np.unique(parts[0] if len(parts) == 1 else np.concatenate(parts), return_counts=True)
        self.keys.append(found | self.sources.setdefault(source, len(self.sources)) << 32)
        self.n.append(n)
        self.held += len(found)
        if self.held >= HELD:
            self.sum_up()

    def enter(self) -> None:
        """The terms that came since the last time become leaves."""
        self.trie.insert(sorted(islice(self.known.items(), self.trie.leaves, None)))

    def sum_up(self) -> None:
        """One counter for each leaf and source; the first in the lists is of earlier sums."""
        grown = np.zeros(len(self.known), np.int64)
        grown[: len(self.docs)] = self.docs
        for keys in self.keys[bool(len(self.docs)) :]:
            grown[keys & 0xFFFFFFFF] += 1
        keys, n = _summed(np.concatenate(self.keys), np.concatenate(self.n))
        self.keys, self.n, self.docs, self.held = [keys], [n], grown, 0

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """The leaves in byte order."""
        self.enter()
        if not self.trie.leaves:
            return
        self.sum_up()
        walked = list(self.trie.walk())
        rank = np.empty(len(walked), np.int64)
        leaves = np.fromiter((leaf for _, leaf in walked), np.int64, len(walked))
        rank[leaves] = np.arange(len(walked))
        owners = rank[self.keys[0] & 0xFFFFFFFF]
        order = np.argsort(owners, kind="stable")
        sources = pa.array(list(self.sources), pa.string()).take(pa.array(self.keys[0][order] >> 32))
        terms = pa.array([term for term, _ in walked], pa.binary()).cast(pa.string())
        columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(walked), np.int64))), terms, pa.array(self.docs[leaves]), _lists(owners[order], len(walked), sources, self.n[0][order])]
        yield from pa.Table.from_arrays(columns, schema=_LEAF_ARROW).to_batches(max_chunksize=50_000)


def _group_rows(groups: Counter) -> pa.RecordBatch:
    """A row without a term for each group, with its documents."""
    counts = [[{"source": source, "n": 0}] for _, source in groups]
    return pa.RecordBatch.from_pydict({"lang": [lang for lang, _ in groups], "term": [""] * len(groups), "docs": list(groups.values()), "counts": counts}, schema=_LEAF_ARROW)


def _leaf_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies: dict[str, _Tally] = {}
    groups: Counter = Counter()
    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"]):
            groups[lang, source] += 1
            tally = tallies.get(lang)
            if tally is None:
                tally = tallies[lang] = _Tally()
            tally.add(source, text.as_py())
        for tally in tallies.values():
            tally.enter()
        if sum(t.trie.leaves for t in tallies.values()) >= LEAVES:
            for lang in sorted(tallies):
                yield from tallies.pop(lang).rows(lang)
    for lang in sorted(tallies):
        yield from tallies.pop(lang).rows(lang)
    if groups:
        yield _group_rows(groups)


def _merged(leaves: pa.Table) -> pa.Table:
    """One leaf of each run of equal ones."""
    leaves = leaves.combine_chunks()
    lang, term = leaves["lang"].chunk(0), leaves["term"].chunk(0)
    same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    lists = leaves["counts"].chunk(0)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lang)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    owner = np.searchsorted(first, row, side="right") - 1
    sources = flat.field("source").dictionary_encode()
    keys, n = _summed(owner << 32 | sources.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.field("n").to_numpy(zero_copy_only=False))
    docs = np.add.reduceat(leaves["docs"].to_numpy(), first)
    at = pa.array(first)
    return pa.Table.from_arrays([lang.take(at), term.take(at), pa.array(docs), _lists(keys >> 32, len(first), sources.dictionary.take(pa.array(keys & 0xFFFFFFFF)), n)], schema=_LEAF_ARROW)


def _merging(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last leaf may go on in the next batch; it is held as one row, however many it came as.
        last = _LEAF_ARROW.empty_table()
        for batch in batches:
            if batch.num_rows:
                merged = _merged(pa.concat_tables([last, pa.Table.from_batches([batch]).cast(_LEAF_ARROW)]))
                last, done = merged.slice(merged.num_rows - 1), merged.slice(0, merged.num_rows - 1)
                yield from done.filter(pc.greater_equal(done["docs"], least)).combine_chunks().to_batches()
        yield from last.filter(pc.greater_equal(last["docs"], least)).to_batches()

    return run


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, counts): the leaves of all tries, and a row with an empty term for each group in a partition."""
    bounded_batches(docs)
    rows = docs.select(text_or_empty("lang").cast("string").alias("lang"), text_or_empty("source").cast("string").alias("source"), text_or_empty("text").cast("binary").alias("text"))
    return rows.mapInArrow(_leaf_rows, _LEAF)


def kept_terms(found: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, counts, total): the terms in enough documents of their language, with their occurrences by source, in order of prefix."""
    ranged = found.where("term <> ''").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return ranged.mapInArrow(_merging(least_docs), _LEAF).select("lang", "term", "counts", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("total"))


def _whole(c: Column, digits: int = 20) -> Column:
    return c.cast(f"decimal({digits},0)")


def share(count: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / size), exactly."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * _whole(count + SMOOTHING), _whole(size)) + 1


def _shares(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same of arrays: a long division by thousands, as the product may pass 64 bits."""
    if len(sizes) and int(sizes.max()) >= 1 << 53:
        return np.array([[1 + SCALE * (c + SMOOTHING) // d for c, d in zip(row, sizes.tolist())] for row in counts.tolist()], np.int64).reshape(counts.shape)
    quotient, rest = np.divmod(counts + SMOOTHING, sizes)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, sizes)
        quotient = quotient * 1000 + digit
    return quotient + 1


_PAIR = "lang string, a string, b string, value long"


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of differences over this partition's terms for each pair a < b of a language's sources."""
    held, sources, sums = None, None, None

    def done() -> Iterator[pa.RecordBatch]:
        if sums is not None and len(sources) > 1:
            for a in range(len(sources) - 1):
                rest = len(sources) - a - 1
                yield pa.RecordBatch.from_pydict({"lang": [held] * rest, "a": [sources[a]] * rest, "b": sources[a + 1 :], "value": pa.array(sums[a, a + 1 :])})

    for batch in batches:
        langs, at = batch["lang"].to_pylist(), 0
        while at < batch.num_rows:
            if langs[at] != held:
                yield from done()
                held, groups = langs[at], batch["groups"][at].as_py()
                sources, sizes = [g["source"] for g in groups], np.array([g["size"] for g in groups], np.int64)
                value_set, sums = pa.array(sources, pa.string()), np.zeros((len(sources), len(sources)), np.int64)
            end, most = at, at + max(CELLS // len(sources), 1)
            while end < min(batch.num_rows, most) and langs[end] == held:
                end += 1
            lists = batch["counts"].slice(at, end - at)
            flat = lists.flatten()
            row = np.repeat(np.arange(end - at), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            counts = np.zeros((end - at, len(sources)), np.int64)
            counts[row, pc.index_in(flat.field("source"), value_set).to_numpy(zero_copy_only=False)] = flat.field("n").to_numpy(zero_copy_only=False)
            p = _shares(counts, sizes)
            for a in range(len(sources) - 1):
                sums[a, a + 1 :] += np.abs(p[:, a + 1 :] - p[:, a : a + 1]).sum(axis=0)
            at = end
    yield from done()


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: the other sources of the language by the sum of the differences of their shares over all kept terms.
    Part ``term``: the first terms that the source has more of than its language.
    """
    found = written(leaves(docs), "leaves")
    terms = written(kept_terms(found, least_docs), "terms")
    rows = terms.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    groups = found.where("term = ''").select("lang", F.explode("counts.source").alias("source")).distinct()
    sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all_words"))
    sized = groups.join(sums, ["lang", "source"], "left").join(kept, "lang", "left")
    smooth = SMOOTHING * F.coalesce("kept", F.lit(0))
    sized = written(sized.select("lang", "source", (F.coalesce("words", F.lit(0)) + smooth).alias("size"), (F.coalesce("all_words", F.lit(0)) + smooth).alias("lang_size")), "groups")
    drop_written(found)

    lists = written(sized.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "size"))).alias("groups")), "sources")
    pairs = terms.select("lang", "counts").join(lists, "lang").select("lang", "counts", "groups").mapInArrow(_pair_sums, _PAIR).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p"), "value").select("lang", "p.*", "value")
    others = lists.select("lang", F.col("groups.source").alias("sources")).select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.explode("sources").alias("item")).where("source <> item")
    pair = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    p, q = share(F.col("n"), F.col("size")), share(F.col("total"), F.col("lang_size"))
    more = rows.join(sized, ["lang", "source"]).where("n > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = more.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= ranks)
    return pair.withColumn("rank", F.row_number().over(by_value)).unionByName(first)
