"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolyte.llm.common import drop_written, written


def _towards_least(neighbours: DataFrame) -> DataFrame:
    """(u, v, m): each row with the least of u and its neighbours.

    The minima are written, so both sides of the join have exchanges of their own and a hub's rows can be split.
    """
    least = written(neighbours.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    return neighbours.join(least.hint("shuffle_merge"), "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of the component of each node of ``edges`` (columns a and b), but for the least itself.

    Each round keeps one row for each edge at most; the rounds grow with the logarithm of the longest path. Loops and
    repeated edges don't matter; no edges give no rows; edges with a null end are left out.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, seen = written(pairs, "edges"), None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        small = _towards_least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        following = written(small.select("e.u", "e.v").where("u <> v").distinct(), "small-star")
        drop_written(state)
        drop_written(large)
        state = following
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now
