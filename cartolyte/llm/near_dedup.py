"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

Elements are shingles of five words; one that a document has n times weighs 1 + log2(n), so that a line repeated a
hundred times doesn't outweigh all else. Similarity is the probability Jaccard index J_P of two weighted sets, which
for documents without repeats is the Jaccard index. One minus J_P is a metric.

Signature. Each element is a Poisson process whose rate is its weight: arrival times are sums of exponential gaps, and
each arrival falls to a random register, which keeps the element of its first arrival. An element stops as soon as its
time passes the latest first arrival of all registers. Two documents agree in a register with probability J_P.

Candidates. ``BANDS`` bands of ``ROWS`` registers: a pair at 0.8 is missed with probability 8e-6. Documents with the
same weighted set are one class from the start and have one representative, so exact copies add no candidates. In each
bucket every representative is verified against the least one; linked ones join into components, and pairs within a
component are never formed. What is left in a bucket is pairs between components: its members outside the bucket's largest
component meet all others, so a large group with a few outsiders costs its size for each of these, not its square. (A
bucket of very many documents, none of them near to another, would still cost the square in sketches.) The metric rules out those whose
similarities to the bucket's least differ by more than 0.2, and a sketch of two bits a register those that differ in
more registers than a pair at 0.8 does but with probability 4e-6. The rest, in the first bucket that a pair shares, is
verified, so no link between candidate pairs is lost.

Defined cases: null and empty texts have no shingles and are classes of their own; texts of one to four words have one
shingle, all of their words; repeated texts share a class; ties don't arise, as classes are named by the least id; an
empty table gives an empty result; other columns are ignored. Rows of one id are one document, near to whatever either
text is near to. A row with a null id names no class unless its text's set has other ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolyte.llm.common import among, ids_as_text, ids_restored, without, written
from cartolyte.llm.components import connected_components
from cartolyte.llm.pretokens import _mix, blocks
from cartolyte.llm.words import run_hashes, split_words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 64, 8


def weighted_shingles(texts: list[str], n: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, ascending, and how often it has them."""
    w = split_words(texts)
    runs = run_hashes(w.hashes, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        own = runs[a : b - n + 1] if b - a >= n else run_hashes(w.hashes[a:b], b - a, seed=b - a) if b > a else runs[:0]
        out.append(np.unique(own, return_counts=True))
    return out


def weights_of(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log2(counts)


def signature(elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """The element of the first arrival in each of ``m`` registers."""
    first, holder = np.full(m, np.inf), np.zeros(m, np.uint64)
    alive, time, weight = elements, np.zeros(len(elements)), weights
    done, batch = 0, -(-8 * m // len(elements))
    while len(alive):
        with np.errstate(over="ignore"):
            seeds = _mix(alive[:, None] + np.arange(done + 1, done + batch + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
            register = (_mix(seeds) >> np.uint64(40)).astype(np.int64) % m
        gaps = -np.log(((seeds >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
        at = time[:, None] + np.cumsum(gaps, axis=1) / weight[:, None]
        np.minimum.at(first, register.ravel(), at.ravel())
        e, r = np.nonzero(at == first[register])
        holder[register[e, r]] = alive[e]
        stay = at[:, -1] < first.max()
        alive, time, weight = alive[stay], at[stay, -1], weight[stay]
        done, batch = done + batch, 2 * batch
    return holder


def jaccard_p(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """J_P of two weighted sets, given as ascending elements and their weights."""
    shared, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    if wx.max() == 1 and wy.max() == 1:
        return len(shared) / (len(x) + len(y) - len(shared))
    # An element j outweighs i in y exactly if its ratio y/x is greater.
    a, b = wx[ix], wy[iy]
    ratio = b / a
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    last = np.searchsorted(ratio, ratio, side="right")
    below = np.concatenate([[0.0], np.cumsum(a)])[last] + (wx.sum() - a.sum())
    above = b.sum() - np.concatenate([[0.0], np.cumsum(b)])[last] + (wy.sum() - b.sum())
    return float((1.0 / (below / a + above / b)).sum())


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, f1, f2, keys, bits): the fingerprint of the weighted set, the band keys, and two bits of each register.

    All but the id are null without shingles.
    """
    factors = _mix(np.arange(rows, dtype=np.uint64)) | np.uint64(1)

    def run(frames):
        for frame in frames:
            texts, ids = frame["text"].fillna("").tolist(), frame["doc_id"].to_numpy()
            for a, b in blocks(texts):
                f1, f2, keys, bits = [], [], [], []
                with np.errstate(over="ignore"):
                    for elements, counts in weighted_shingles(texts[a:b]):
                        if not len(elements):
                            f1.append(None), f2.append(None), keys.append(None), bits.append(None)
                            continue
                        both = _mix(elements + counts.astype(np.uint64))
                        f1.append(int(both.sum().view(np.int64)))
                        f2.append(int(_mix(both).sum().view(np.int64)))
                        z = signature(elements, weights_of(counts), bands * rows)
                        two = _mix(z ^ np.uint64(0xA5A5))
                        bits.append(np.concatenate([np.packbits((two >> np.uint64(k)).astype(np.uint8) & 1).view(np.int64) for k in (20, 21)]))
                        z = z.reshape(bands, rows)
                        keys.append(_mix((z * factors).sum(axis=1) + np.arange(bands, dtype=np.uint64)).view(np.int64))
                yield pd.DataFrame({"doc_id": ids[a:b], "f1": pd.array(f1, "Int64"), "f2": pd.array(f2, "Int64"), "keys": keys, "bits": bits})

    out = ids_as_text(docs, "doc_id", F.col("text")).mapInPandas(run, "doc_id string, f1 long, f2 long, keys array<long>, bits array<long>")
    return ids_restored(out, docs, "doc_id")


def shingle_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, elements, counts) of the documents in ``ids``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            texts, own = frame["text"].fillna("").tolist(), frame["doc_id"].to_numpy()
            for a, b in blocks(texts):
                sets = weighted_shingles(texts[a:b])
                yield pd.DataFrame({"doc_id": own[a:b], "elements": [e.view(np.int64) for e, _ in sets], "counts": [c if len(c) and c.max() > 1 else c[:0] for _, c in sets]})

    return among(docs.select("doc_id", "text"), ids).mapInPandas(run, f"doc_id {kind}, elements array<long>, counts array<long>")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) for each pair (a, b) of ids."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            out = []
            for x, wx, y, wy in zip(frame["xe"], frame["xc"], frame["ye"], frame["yc"]):
                x, y = np.asarray(x).view(np.uint64), np.asarray(y).view(np.uint64)
                out.append(jaccard_p(x, weights_of(np.asarray(wx)) if len(wx) else np.ones(len(x)), y, weights_of(np.asarray(wy)) if len(wy) else np.ones(len(y))))
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "similarity": np.array(out, float)})

    side = lambda id_, e, c: sets.select(F.col("doc_id").alias(id_), F.col("elements").alias(e), F.col("counts").alias(c)).hint("shuffle_merge")
    return pairs.join(side("a", "xe", "xc"), "a").join(side("b", "ye", "yc"), "b").mapInPandas(run, f"a {kind}, b {kind}, similarity double")


def _differing(n: int) -> Column:
    """In how many registers the two-bit sketches of both sides differ."""
    words = [F.bit_count(F.col(f"p{i}1").bitwiseXOR(F.col(f"p{i}2")).bitwiseOR(F.col(f"q{i}1").bitwiseXOR(F.col(f"q{i}2")))) for i in range(n)]
    return sum(words[1:], words[0])


def most_differing(similarity: float, registers: int) -> int:
    """Registers in which the sketches of a pair of that similarity differ, and 4.5 standard deviations."""
    share = 0.75 * (1 - similarity)
    return int(registers * share + 4.5 * (registers * share * (1 - share)) ** 0.5)


def between(members: DataFrame, n: int, similarity: float, most: int) -> DataFrame:
    """(a, b): the pairs of a bucket's members in different parts that may be similar, each in the first bucket that it shares.

    ``members`` has key, rep, part, main (the part with most members in the bucket), s, keys and the sketch's planes. Of two
    parts one isn't the main one, so the members outside of that, joined with all, give every pair.
    """
    side = lambda rows, i: rows.select("key", *(F.col(c).alias(f"{c}{i}") for c in rows.columns if c != "key"))
    x, y = side(members.where("part <> main"), 1), side(members, 2)
    near = (F.col("part1") != F.col("part2")) & ((F.col("part2") == F.col("main2")) | (F.col("rep1") > F.col("rep2")))
    near &= F.abs(F.col("s1") - F.col("s2")) <= 1 - similarity + 1e-9
    near &= (_differing(n) <= most) & (F.array_min(F.array_intersect("keys1", "keys2")) == x["key"])
    return x.join(y.hint("shuffle_merge"), (x["key"] == y["key"]) & near).select(F.greatest("rep1", "rep2").alias("a"), F.least("rep1", "rep2").alias("b"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id): each document with the least id of its class."""
    signed = written(signatures(docs, bands, rows), "signatures")
    groups = written(signed.where("f1 IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "same-sets")
    labelled = signed.join(groups.hint("shuffle_merge"), ["f1", "f2"], "left").select(
        "doc_id", F.coalesce("rep", "doc_id").alias("rep"), *(F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in ("keys", "bits"))
    )
    labelled = written(labelled, "labelled")

    banded = labelled.select("rep", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    members = written(banded.join(written(buckets, "buckets").hint("shuffle_merge"), "key"), "members")
    sets = written(shingle_table(docs, members.select(F.col("rep").alias("doc_id"))), "sets")

    stars = members.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
    checked = written(verify(stars, sets), "stars")
    enough = F.col("similarity") >= similarity - 1e-9
    links = checked.where(enough).select("a", "b")
    label = connected_components(links)

    # Members of buckets that hold several components. A pair comes up in the first bucket that it shares.
    placed = (
        members.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left")
        .join(checked.select(F.col("a").alias("rep"), F.col("b").alias("least"), "similarity"), ["rep", "least"], "left")
        .select("key", "rep", (F.col("rep") == F.col("least")).alias("is_least"), F.coalesce("label", "rep").alias("part"), F.coalesce("similarity", F.lit(1.0)).alias("s"))
    )
    placed = written(placed, "placed")
    parts = placed.groupBy("key", "part").count().groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("parts"))
    mixed = written(parts.where("parts > 1").select("key", "main"), "mixed")
    open_ = placed.where("NOT is_least").drop("is_least").join(mixed.hint("shuffle_merge"), "key")
    n = bands * rows // 64
    planes = [F.col("bits")[i].alias(f"p{i}") for i in range(n)] + [F.col("bits")[n + i].alias(f"q{i}") for i in range(n)]
    open_ = written(open_.join(labelled.where("keys IS NOT NULL").select("rep", "keys", *planes).hint("shuffle_merge"), "rep"), "open")
    across = between(open_, n, similarity, most_differing(similarity, bands * rows))
    across = written(across.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "across")
    more = verify(across, sets).where(enough).select("a", "b")
    more = written(more, "more-links")
    if not more.isEmpty():
        label = connected_components(links.unionByName(more))
    found = label.select(F.col("node").alias("rep"), F.col("label"))
    return labelled.select("doc_id", "rep").join(found.hint("shuffle_merge"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document of least id of each class, with all columns."""
    return without(docs, near_duplicates(docs).where("doc_id <> class_id"))
