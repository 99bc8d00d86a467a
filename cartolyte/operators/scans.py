"""Operators over ordered rows without a task for each key: scans in segments, and places in a total order.

Rows are partitioned by ranges of their key and order, with borders that Spark samples, so one key can lie in many
stretches. Each stretch gives one row for each of its keys: its first and last rows, how many blocks end in it, its last
value. These few rows are scanned, and what comes before and after a stretch is added to its own scan. The functions of
:mod:`cartolyte.operators.runs` do the same in one window, with one exchange instead of two, and suit short keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolyte.sources.shared import written

#: A row's number within its partition is in the low bits of Spark's increasing ids, the partition's in the others.
_ROW_BITS = 33


def _ranged(df: DataFrame, by: list[str], stretches: int | None) -> DataFrame:
    # A number that is asked for isn't brought down at run time: a key with all rows stays spread.
    return df.repartitionByRange(stretches or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
    blocks: dict[str, Column] | None = None,
    carried: dict[str, Column] | None = None,
    stretches: int | None = None,
) -> DataFrame:
    """``df`` with new columns, by name, over the rows of a key (all rows, if there are no keys) in an order that no two of them share.

    ``before`` and ``after``: a column of the row before or after, null at the ends. ``blocks``: the number of rows
    before that meet a condition. ``carried``: the last value that is not null, the row's own included.
    """
    before, after, blocks, carried = before or {}, after or {}, blocks or {}, carried or {}
    marks = {f"_b_{n}": F.coalesce(c.cast("long"), F.lit(0).cast("long")) for n, c in blocks.items()} | {f"_c_{n}": c for n, c in carried.items()}
    rows = written(_ranged(df, [*keys, *order], stretches).withColumns(marks | {"_stretch": F.shiftright(F.monotonically_increasing_id(), _ROW_BITS)}), "stretches")

    place = F.struct(*order)
    held = lambda names: F.struct(F.lit(True).alias("_"), *(F.col(c).alias(n) for n, c in names.items()))
    ends = rows.groupBy(*keys, "_stretch").agg(
        F.min_by(held(after), place).alias("_first"),
        F.max_by(held(before), place).alias("_last"),
        *(F.sum(f"_b_{n}").alias(f"_b_{n}") for n in blocks),
        *(F.max_by(F.col(f"_c_{n}"), F.when(F.col(f"_c_{n}").isNotNull(), place)).alias(f"_c_{n}") for n in carried),
    )
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_stretch")
    sofar = along.rowsBetween(Window.unboundedPreceding, -1)
    borders = ends.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys),
        F.col("_stretch").alias("_of"),
        F.lag("_last").over(along).alias("_last"),
        F.lead("_first").over(along).alias("_first"),
        *(F.coalesce(F.sum(f"_b_{n}").over(sofar), F.lit(0)).alias(f"_o_{n}") for n in blocks),
        *(F.last(f"_c_{n}", ignorenulls=True).over(sofar).alias(f"_l_{n}") for n in carried),
    )
    same = F.col("_stretch") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    met = rows.join(borders, same)

    own = Window.partitionBy(*keys, "_stretch").orderBy(*order)
    head = own.rowsBetween(Window.unboundedPreceding, -1)
    first, last = F.row_number().over(own) == 1, F.lead(F.lit(1)).over(own).isNull()
    new = {n: F.when(first, F.col(f"_last.{n}")).otherwise(F.lag(c).over(own)) for n, c in before.items()}
    new |= {n: F.when(last, F.col(f"_first.{n}")).otherwise(F.lead(c).over(own)) for n, c in after.items()}
    new |= {n: F.col(f"_o_{n}") + F.coalesce(F.sum(f"_b_{n}").over(head), F.lit(0)) for n in blocks}
    new |= {n: F.coalesce(F.last(f"_c_{n}", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"_l_{n}")) for n in carried}
    return met.select(*df.columns, *(c.alias(n) for n, c in new.items()))


def run_starts(df: DataFrame, keys: list[str], order: list[str], value: str, stretches: int | None = None) -> DataFrame:
    """The first rows, and those whose value differs from the row before. Filters on other columns come after, not before."""
    marked = df.withColumn("_is", F.struct(value))
    out = scan(marked, keys, order, before={"_was": "_is"}, stretches=stretches)
    return out.where(F.col("_was").isNull() | ~F.col(f"_was.{value}").eqNullSafe(F.col(value))).select(*df.columns)


def with_next(df: DataFrame, keys: list[str], order: list[str], columns: list[str], stretches: int | None = None) -> DataFrame:
    """Each row with the next row's columns as ``next_<name>``, null for the last."""
    return scan(df, keys, order, after={f"next_{c}": c for c in columns}, stretches=stretches)


def with_block(df: DataFrame, keys: list[str], order: list[str], closes: Column, stretches: int | None = None) -> DataFrame:
    """Each row with the number of the block that it is in; a closing row is its block's last."""
    return scan(df, keys, order, blocks={"block": closes}, stretches=stretches)


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, stretches: int | None = None) -> DataFrame:
    """Each row with the last value that is not null, its own included."""
    return scan(df, keys, order, carried={name: value}, stretches=stretches)


def total_places(df: DataFrame, order: list[str], name: str = "place", stretches: int | None = None) -> DataFrame:
    """Each row with its place, from 1, in an order of all rows that no two of them share.

    One exchange by sampled ranges: a row's place is its number within its range and the sizes of the ranges before, of
    which the driver adds up one for each partition.
    """
    rows = written(_ranged(df, order, stretches).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    stretch = F.shiftright("_id", _ROW_BITS)
    sizes = sorted((r["s"], r["n"]) for r in rows.groupBy(stretch.alias("s")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for s, n in sizes:
        starts.append((s, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_stretch long, _before long")
    within = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    met = rows.withColumn("_stretch", stretch).join(F.broadcast(offsets), "_stretch")
    return met.select(*df.columns, (F.col("_before") + within + 1).alias(name))
