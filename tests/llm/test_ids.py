"""Null, repeated and very large ids in every operator on documents."""

import public_tokenizers
import pytest

from cartolyte.llm import bpe, common, exact_dedup, near_dedup, packing, quality, substring_dedup

BIG = (1 << 60) + 1
ROWS = [(BIG, "a b c d e f g"), (None, "null id here, of some words"), (3, "twice"), (3, "twice"), (3, "other text " * 30), (BIG + 1, "a b c d e f g"), (None, "other text " * 30)]


@pytest.mark.parametrize(
    "run",
    [
        lambda s, d: bpe.digests(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
        lambda s, d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")),
        lambda s, d: exact_dedup.exact_dedup(d),
        lambda s, d: near_dedup.near_duplicates(d),
        lambda s, d: substring_dedup.substring_dedup(d),
        lambda s, d: quality.score(d, s.createDataFrame([(BIG, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")),
    ],
)
def test_ids_survive(spark, run):
    got = [r["doc_id"] for r in run(spark, spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)).collect()]
    assert len(got) >= len(ROWS) and set(got) == {BIG, BIG + 1, 3, None}


def test_repeats_within_ids(spark):
    got = substring_dedup.substring_dedup(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    removed = sorted((r["n_words"], r["n_removed"]) for r in got)
    # The null id's copy comes first: its windows from the third on have started before, so all but two words go.
    assert removed == [(1, 0), (1, 0), (6, 0), (7, 0), (7, 0), (60, 58), (60, 60)]


@pytest.mark.parametrize("bound", [0, 1000])
def test_ids_to_drop_are_measured_by_their_bytes(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    docs = spark.createDataFrame([("a", 1), ("b" * 40, 2), (None, 3)], "doc_id string, n int")
    gone = docs.where("n = 2")
    kept, own = common.without(docs, gone), common.among(docs, gone)
    assert sorted(r["n"] for r in kept.collect()) == [1, 3] and [r["n"] for r in own.collect()] == [2]
    plan = common._broadcast_if_small(gone.select("doc_id"))._jdf.queryExecution().logical().toString()
    assert ("Hint" in plan) == (bound > 0)
