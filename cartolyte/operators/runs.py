"""Operators over ordered rows of a group: runs, positions, adjacent rows, text blocks, carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def run_starts(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The first rows, and those whose value differs from the row before. Filters on other columns come after, not before."""
    before = F.lag(F.struct(value)).over(_window(keys, order))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col(f"_before.{value}"))).drop("_before")


def positions(df: DataFrame, keys: list[str], order: list[str], first: int, last: int) -> DataFrame:
    """Rows number first..last (from 1) of each group, as ``pos``."""
    return df.withColumn("pos", F.row_number().over(_window(keys, order)).cast("long")).where(F.col("pos").between(first, last))


def with_next(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row with the next row's columns as ``next_<name>``, null for the last."""
    w = _window(keys, order)
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})


def with_block(df: DataFrame, keys: list[str], order: list[str], closes: Column) -> DataFrame:
    """Each row with the number of the block that it is in; a closing row is its block's last."""
    before = _window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("block", F.coalesce(F.sum(closes.cast("long")).over(before), F.lit(0).cast("long")))


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Each row with the last value that is not null, its own included."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def places(df: DataFrame, keys: list[str], order: list[str], seq: str, width: int = 1024) -> DataFrame:
    """Each row with its ``place`` (from 1) among its keys by ``order`` and then ``seq``, an integer that no two of these share.

    Rows are numbered within stretches of ``seq`` and stretches by their counts, so no task sorts all rows of a key.
    """
    by = [*keys, *order, "_part"]
    parted = df.withColumn("_part", F.floor(F.col(seq) / width))
    counts = parted.groupBy(*by).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(_window(keys, [*order, "_part"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(_window(by, [seq]))
    return parted.withColumn("_own", own).join(counts.select(*by, before.alias("_before")), by).withColumn("place", (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")
