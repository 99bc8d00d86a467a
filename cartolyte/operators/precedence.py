"""Which of several rows for a key counts: by layers, by load order, by unordered pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one(df: DataFrame, keys: list[str], pick) -> DataFrame:
    # An aggregate combines before the shuffle, so a key with many rows sends few; a window would gather them.
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest)).alias("_row")).select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of greatest ``order`` of each key: a later layer replaces an earlier one."""
    return _one(df, keys, lambda row: F.max_by(row, F.col(order)))


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of least ``order`` of each key."""
    return _one(df, keys, lambda row: F.min_by(row, F.col(order)))


def one_per_pair(df: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """(a, b) and (b, a) are the same: the row of least ``order``, with the ends in order as ``lo`` and ``hi``."""
    return first_wins(df.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b)), ["lo", "hi"], order)


def layer_order(priority: list[str]) -> dict[str, int]:
    """The layer number of each name of a list whose first entry has the highest priority."""
    return {name: len(priority) - i for i, name in enumerate(priority)}
