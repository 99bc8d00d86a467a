"""A pyramid of square tiles over lines and areas, cut at the finest zoom.

Things are cut to the tiles of the last zoom: the sides of a line or area by columns, the inside of an area by rows.
A coarser tile holds what the tiles of the last zoom in it hold. In a column a side has one run of rows, and so it has in
the wider columns of a coarser zoom, from the ends of its first and last fine column; so each zoom is made from the sides
and runs of the things, without the rows of another zoom. A tile's key interleaves the bits of its column and row. A thing belongs
to a tile if, widened by a margin each way, it meets it; a tile has its lower edges, not its upper ones.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolyte.operators.layout import _spread
from cartolyte.sources.shared import spread, tasks, written

#: Zoom of the finest tiles at most, as keys are spread from 16 bits.
MOST_ZOOM = 16
#: Sides and runs for each range of tiles that is sorted as one.
_RANGE = 100_000


def tile_key(tx: Column, ty: Column) -> Column:
    return _spread(tx.cast("long")).bitwiseOR(F.shiftleft(_spread(ty.cast("long")), 1))


def _gather(bits: Column) -> Column:
    """The even bits of a key; the inverse of spreading them."""
    bits = bits.bitwiseAND(F.lit(0x55555555).cast("long"))
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        bits = bits.bitwiseOR(F.shiftright(bits, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return bits


def tile_of(key: Column) -> tuple[Column, Column]:
    """The column and row of a key."""
    return _gather(key), _gather(F.shiftright(key, 1))


def _at(v: Column, low: float, step: float) -> Column:
    """The number of the stripe that a value lies in."""
    return F.floor((v - F.lit(low)) / F.lit(step))


def _first(v: Column, low: float, step: float) -> Column:
    return F.greatest(_at(v, low, step), F.lit(0).cast("long"))


def _last(v: Column, low: float, step: float, n: int) -> Column:
    return F.least(_at(v, low, step), F.lit(n - 1).cast("long"))


def _left(v: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", v, bits)


def _right(v: Column, bits: Column) -> Column:
    return F.call_function("shiftright", v, bits)


def _numbers(first: Column, last: Column, bits: Column) -> Column:
    """The numbers from the first to the last, without their lower bits, as rows; none where the last is below."""
    return F.explode(F.when(first <= last, F.sequence(_right(first, bits), _right(last, bits))))


def _checked(zooms: Iterable[int]) -> Iterable[int]:
    if not 0 <= min(zooms) <= max(zooms) <= MOST_ZOOM:
        raise ValueError(f"zooms go from 0 to {MOST_ZOOM}")
    return zooms


def _held(items: DataFrame) -> DataFrame:
    known = F.filter("points", lambda p: p["x"].isNotNull() & p["z"].isNotNull())
    return items.select("id", F.coalesce("closed", F.lit(False)).alias("closed"), known.alias("points"))


def _sides(held: DataFrame) -> DataFrame:
    """(id, several, x0, z0, x1, z1): the sides of lines, and of areas with the one that closes them; a line of one point is a side of no length.

    ``several`` says whether more tiles of the same thing may come from elsewhere: from other sides, also of rows with the same id, or from inside.
    """
    p, n, i = F.col("points"), F.coalesce(F.size("points"), F.lit(0)), F.col("i")
    ends = F.when(F.col("closed"), n).otherwise(F.greatest(n - 1, F.least(n, F.lit(1))))
    rows = held.select("id", "closed", "points", F.explode(F.when(ends > 0, F.sequence(F.lit(0), ends - 1))).alias("i"))
    to = F.coalesce(F.get(p, i + 1), F.when(F.col("closed"), F.get(p, F.lit(0))), F.get(p, i))
    several = F.col("closed") | (F.count("*").over(Window.partitionBy("id")) > 1)
    rows = rows.select("id", several.alias("several"), F.get(p, i).alias("a"), to.alias("b"))
    return rows.select("id", "several", *(F.col(f"{e}.{c}").cast("double").alias(f"{c}{k}") for k, e in enumerate("ab") for c in "xz"))


def _at_zooms(rows: DataFrame, zooms: Iterable[int]) -> DataFrame:
    return rows.withColumn("zoom", F.explode(F.array(*map(F.lit, zooms))))


def side_tiles(sides: DataFrame, zooms: Iterable[int], last: int, low: float, side: float, margin: float) -> DataFrame:
    """(zoom, id, tx, ty) of the tiles that the sides meet: in each column, the rows between the heights at which a side comes in and goes out.

    Columns and rows are those of the last zoom, less their lower bits. A side gives each tile once.
    """
    n, step, bits = 1 << last, side / (1 << last), last - F.col("zoom")
    x0, z0, x1, z1 = map(F.col, ("x0", "z0", "x1", "z1"))
    left, right = F.least(x0, x1), F.greatest(x0, x1)
    rows = sides.select("id", "x0", "z0", "x1", "z1", _first(left - margin, low, step).alias("c0"), _last(right + margin, low, step, n).alias("c1"))
    rows = _at_zooms(rows, zooms).withColumn("tx", _numbers(F.col("c0"), F.col("c1"), bits))
    begin = F.greatest(_left(F.col("tx"), bits), F.col("c0")) * step + low
    end = F.least(_left(F.col("tx") + 1, bits) - 1, F.col("c1")) * step + low + step
    height = lambda x: z0 + (z1 - z0) * (x - x0) / F.when(x0 == x1, 1.0).otherwise(x1 - x0)
    a = F.when(x0 == x1, z0).otherwise(height(F.greatest(left, begin - margin)))
    b = F.when(x0 == x1, z1).otherwise(height(F.least(right, end + margin)))
    rows = rows.select("zoom", "id", "tx", a.alias("a"), b.alias("b"))
    rows = rows.select("zoom", "id", "tx", _first(F.least("a", "b") - margin, low, step).alias("r0"), _last(F.greatest("a", "b") + margin, low, step, n).alias("r1"))
    return rows.select("zoom", "id", "tx", _numbers(F.col("r0"), F.col("r1"), bits).alias("ty"))


def inner_runs(held: DataFrame, last: int, low: float, side: float) -> DataFrame:
    """(id, ty, c0, c1): the runs of tiles of the last zoom whose centre lies in an area, by the even-odd rule: in each row, between each two crossings of its middle line."""
    n, step = 1 << last, side / (1 << last)
    zs = F.transform("points", lambda p: p["z"].cast("double"))
    rows = held.where("closed").select("id", "points", _first(F.array_min(zs), low, step).alias("r0"), _last(F.array_max(zs), low, step, n).alias("r1"))
    rows = rows.select("id", "points", _numbers(F.col("r0"), F.col("r1"), F.lit(0)).alias("ty"))
    middle, p = (F.col("ty") + 0.5) * step + low, F.col("points")
    number = F.transform(p, lambda _, i: i)
    edge = lambda i: (F.get(p, i), F.coalesce(F.get(p, i + 1), F.get(p, F.lit(0))))
    crossing = lambda a, b: a["x"] + (F.col("middle") - a["z"]) * (b["x"] - a["x"]) / (b["z"] - a["z"])
    across = F.filter(number, lambda i: (edge(i)[0]["z"] <= F.col("middle")) != (edge(i)[1]["z"] <= F.col("middle")))
    rows = rows.withColumn("middle", middle).select("id", "ty", F.sort_array(F.transform(across, lambda i: crossing(*edge(i)))).alias("xs"))
    pairs = F.filter(F.transform("xs", lambda x, i: F.struct(x.alias("a"), F.get("xs", i + 1).alias("b"), i.alias("i"))), lambda s: s["i"] % 2 == 0)
    inside = rows.select("id", "ty", F.explode(pairs).alias("s"))
    first = lambda x: F.ceil((x - low) / step - 0.5)
    from_, to = F.greatest(first(F.col("s.a")), F.lit(0).cast("long")), F.least(first(F.col("s.b")) - 1, F.lit(n - 1).cast("long"))
    return inside.select("id", "ty", from_.alias("c0"), to.alias("c1"))


def _tiles(sides: DataFrame, runs: DataFrame, zooms: Iterable[int], last: int, low: float, side: float, margin: float) -> DataFrame:
    """(zoom, key, id) of the zooms, each once. The only side of a thing meets a tile once, so only tiles of several sides, and of areas, are made distinct."""
    met = lambda some: side_tiles(some, zooms, last, low, side, margin)
    keyed = lambda rows: rows.select("zoom", tile_key(F.col("tx"), F.col("ty")).alias("key"), "id")
    bits = last - F.col("zoom")
    inner = _at_zooms(runs, zooms).select("zoom", "id", _numbers(F.col("c0"), F.col("c1"), bits).alias("tx"), _right(F.col("ty"), bits).alias("ty"))
    return keyed(met(sides.where("NOT several"))).unionByName(keyed(met(sides.where("several")).unionByName(inner).distinct()))


def finest(items: DataFrame, zoom: int, low: float, side: float, margin: float = 0.0) -> DataFrame:
    """(id, key): the tiles of a zoom that things (id, closed, points as an array of x and z) belong to, each once."""
    zooms = _checked([zoom])
    held = _held(items)
    return _tiles(_sides(held), inner_runs(held, zoom, low, side), zooms, zoom, low, side, margin).select("id", "key")


def write_pyramid(items: DataFrame, zooms: range, low: float, side: float, margin: float, path: str) -> DataFrame:
    """(zoom, key, id) of all zooms, written under ``path`` as a folder for each zoom with tiles, sorted by tile and thing.

    Things are spread over tasks, as a small table of them may come from one file, and their sides and runs are written to
    the shared folder. All zooms take one exchange, into so many ranges that a task's share of rows doesn't grow with the
    table. A tile that most things belong to is spread over tasks and files.
    """
    spark: SparkSession = items.sparkSession
    last = max(_checked(zooms))
    held = _held(spread(items, "id"))
    sides, runs = written(_sides(held), "sides"), written(inner_runs(held, last, low, side), "runs")
    rows = _tiles(sides, runs, zooms, last, low, side, margin)
    ranges = max(tasks(spark), (sides.count() + runs.count()) // _RANGE)
    ranged = rows.repartitionByRange(ranges, "zoom", "key", "id").sortWithinPartitions("zoom", "key", "id")
    # Without the mark of a whole job, which would lie beside the folders of the zooms.
    ranged.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("zoom").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
