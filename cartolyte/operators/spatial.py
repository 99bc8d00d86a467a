"""Viewport filters and joins of points with rectangles by a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolyte.sources.shared import written

#: Margin around a viewport (fixed value).
MARGIN = 1000


def in_viewport(x: Column, z: Column, x0, z0, x1, z1, margin: float = MARGIN) -> Column:
    return x.between(F.lit(x0 - margin), F.lit(x1 + margin)) & z.between(F.lit(z0 - margin), F.lit(z1 + margin))


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("z").alias("min_z"), F.max("z").alias("max_z"))


def _cell(value: Column, size: Column) -> Column:
    return F.floor(value / size).cast("long")


#: Sides beyond this count as infinite.
_LARGEST = 1e300


def rect_cells(rects: DataFrame, size: float) -> DataFrame:
    """Rectangles (rx, rz, w, h, ...) with level, cx, cz: a row for each cell that they touch, of a grid that fits them.

    The cells of level k are 2^k times ``size`` wide. A rectangle is of the first level whose cells are no smaller than
    its sides, so it touches two cells each way, or three where rounding makes a difference. Those with a null, NaN or negative side hold no point.
    """
    side = F.least(F.greatest("w", "h"), F.lit(_LARGEST))
    level = F.when(side <= size, 0).otherwise(F.ceil(F.log2(side / F.lit(float(size)))).cast("int"))
    sound = (F.col("w") >= 0) & (F.col("h") >= 0) & ~F.isnan("w") & ~F.isnan("h") & ~F.isnan(F.col("rx").cast("double")) & ~F.isnan(F.col("rz").cast("double"))
    held = rects.where(sound).withColumn("level", level).withColumn("_size", F.lit(float(size)) * F.pow(F.lit(2.0), "level"))

    def touched(low: str, length: str) -> Column:
        first = _cell(F.col(low), F.col("_size"))
        return F.explode(F.sequence(first, F.least(_cell(F.col(low) + F.col(length), F.col("_size")), first + 2)))

    return held.withColumn("cx", touched("rx", "w")).withColumn("cz", touched("rz", "h")).drop("_size")


#: Stripes that points are cut into each way, as a power of two: about as many points in each.
_STRIPE_BITS = 8
_STRIPES = 1 << _STRIPE_BITS


def _stripe(value: Column, borders: Column) -> Column:
    """The number of the stripe that a value lies in, by halving; greater values never have smaller numbers."""
    halves = F.array(*(F.lit(1 << b) for b in reversed(range(_STRIPE_BITS))))
    return F.when(value.isNotNull(), F.aggregate(halves, F.lit(0), lambda at, n: F.when(F.get(borders, at + n - 1) <= value, at + n).otherwise(at)))


def _with_stripes(df: DataFrame, around: Column, values: dict[str, tuple[Column, str]]) -> DataFrame:
    """Stripes of values by name, on the axis that each is given with."""
    out = df.withColumn("_around", around)
    return out.withColumns({name: _stripe(v, F.col(f"_around.{axis}")) for name, (v, axis) in values.items()})


def _pieces(first: Column, last: Column) -> Column:
    """(node, whole) of a range of stripes: the fewest nodes of a binary tree that make up what lies between its ends, and its ends, unless they are beyond the points."""
    low, high = first + (_STRIPES + 1), last + _STRIPES
    whole = []
    for level in range(_STRIPE_BITS + 1):
        a, b = F.shiftright(low + ((1 << level) - 1), level), F.shiftright(high, level)
        whole += [F.when((a < b) & (a % 2 == 1), a), F.when((a < b) & (b % 2 == 1), b - 1)]
    ends = F.array_distinct(F.array_compact(F.array(F.when(first >= 0, low - 1), F.when(last < _STRIPES, high))))
    piece = lambda is_whole: lambda n: F.struct(n.alias("node"), F.lit(is_whole).alias("whole"))
    return F.concat(F.transform(F.array_compact(F.array(*whole)), piece(True)), F.transform(ends, piece(False)))


def _above(stripe: Column) -> Column:
    """A stripe's node and all around it."""
    return F.array(*(F.shiftright(stripe + _STRIPES, level) for level in range(_STRIPE_BITS + 1)))


def grid_join(points: DataFrame, rects: DataFrame, point_id: str, rect_id: str, order: str, size: float = 0.0) -> DataFrame:
    """(point_id, rect_id): the first rectangle by ``order`` that holds each point, all edges included; null if none.

    Of equal rectangles only the first counts. Points are cut into stripes of about as many points each way, and a binary
    tree is laid over these. A rectangle's range each way is a few whole nodes and the two stripes of its edges. Where
    both ways are whole, it holds all points there, so each pair of nodes keeps its first rectangle only, whatever number
    of rectangles covers it. Only points in the stripe of an edge are compared with the rectangle: they are a share
    of about 4 to 2^8 of all. Those without a rectangle come back by a left join. The stripes follow the points, so ``size``, that of the cells of a fixed grid, is not needed.
    """
    x1, z1 = F.col("rx") + F.col("w"), F.col("rz") + F.col("h")
    sound = (F.col("w") >= 0) & (F.col("h") >= 0) & ~F.isnan("w") & ~F.isnan("h") & ~F.isnan(F.col("rx").cast("double")) & ~F.isnan(F.col("rz").cast("double"))
    edges = [c.cast("double").alias(n) for n, c in (("_x0", F.col("rx")), ("_x1", x1), ("_z0", F.col("rz")), ("_z1", z1))]
    names = ["_x0", "_x1", "_z0", "_z1"]
    distinct = rects.where(sound).select(*edges, F.col(rect_id).alias("_rect"), F.col(order).alias("_order")).groupBy(*names).agg(F.min_by("_rect", "_order").alias("_rect"), F.min("_order").alias("_order"))

    shares = F.expr(f"array({', '.join(f'{i / _STRIPES}D' for i in range(1, _STRIPES))})")
    borders = lambda c: F.percentile_approx(F.col(c).cast("double"), shares, F.lit(10 * _STRIPES))
    ends = lambda f: [f(F.col(c).cast("double")).alias(f"{f.__name__}_{c}") for c in "xz"]
    around = points.agg(F.struct(borders("x").alias("x"), borders("z").alias("z"), *ends(F.min), *ends(F.max)).alias("around")).scalar()

    cut = _with_stripes(distinct, around, {f"_s{n}": (F.col(n), n[1]) for n in names})
    first = lambda c: F.when(F.col(f"_{c}0") <= F.col(f"_around.min_{c}"), -1).otherwise(F.col(f"_s_{c}0"))
    last = lambda c: F.when(F.col(f"_{c}1") >= F.col(f"_around.max_{c}"), _STRIPES).otherwise(F.col(f"_s_{c}1"))
    # Written, as optimised plans would hold the searches for stripes many times over.
    ranged = cut.select(*names, "_rect", "_order", *(f(c).alias(f"_{n}_{c}") for c in "xz" for n, f in (("first", first), ("last", last))))
    ranged = written(ranged, "rects")
    pieces = ranged.select(*names, "_rect", "_order", *(_pieces(F.col(f"_first_{c}"), F.col(f"_last_{c}")).alias(f"_p{c}") for c in "xz"))
    laid = pieces.withColumn("_px", F.explode("_px")).withColumn("_pz", F.explode("_pz"))
    laid = laid.select(*names, "_rect", "_order", F.col("_px.node").alias("_nx"), F.col("_pz.node").alias("_nz"), (F.col("_px.whole") & F.col("_pz.whole")).alias("_whole"))
    covers = laid.where("_whole").groupBy("_nx", "_nz").agg(F.min_by("_rect", "_order").alias("_rect"), F.min("_order").alias("_order"))

    at = points.select(point_id, F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"))
    placed = written(_with_stripes(at, around, {f"_s{c}": (F.col(c), c) for c in "xz"}).select(point_id, "x", "z", "_sx", "_sz"), "points")
    probes = placed.withColumn("_nx", F.explode(_above(F.col("_sx")))).withColumn("_nz", F.explode(_above(F.col("_sz"))))
    held = probes.join(covers, ["_nx", "_nz"]).select(point_id, "_rect", "_order")
    # An edge lies in a stripe, which is a leaf of the tree, on one way at least.
    near = probes.where((F.col("_nx") >= _STRIPES) | (F.col("_nz") >= _STRIPES)).join(laid.where("NOT _whole"), ["_nx", "_nz"])
    near = near.where(F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("z").between(F.col("_z0"), F.col("_z1"))).select(point_id, "_rect", "_order")
    best = held.unionByName(near).groupBy(point_id).agg(F.min_by("_rect", "_order").alias(rect_id))
    return points.select(point_id).join(best, point_id, "left")


def nested_join(points: DataFrame, rects: DataFrame, point_id: str, rect_id: str, order: str) -> DataFrame:
    """The same by comparing all, for few rectangles; the plan to hold the grid against."""
    inside = F.col("x").between(F.col("rx"), F.col("rx") + F.col("w")) & F.col("z").between(F.col("rz"), F.col("rz") + F.col("h"))
    return points.join(rects, inside, "left").groupBy(point_id).agg(F.min_by(rect_id, order).alias(rect_id))


def tile_features(points: DataFrame, zooms: range, low: float, side: float, margin_share: float) -> DataFrame:
    """The points with zoom, tx, ty: a row for each tile of a square pyramid that holds them, each tile widened by a share of its side.

    Each point unfolds to the few tiles that it touches; tiles are never compared with all points.
    """
    rows = points.withColumn("zoom", F.explode(F.array(*map(F.lit, zooms))))
    step = F.lit(float(side)) / F.pow(F.lit(2.0), F.col("zoom"))
    margin = step * margin_share
    last = F.pow(F.lit(2), F.col("zoom")).cast("long") - 1

    def touched(c: str) -> Column:
        first = F.greatest(F.ceil((F.col(c) - F.lit(low) - margin) / step).cast("long") - 1, F.lit(0).cast("long"))
        end = F.least(F.floor((F.col(c) - F.lit(low) + margin) / step).cast("long"), last)
        return F.when(first <= end, F.sequence(first, end))

    return rows.withColumn("tx", F.explode(touched("x"))).withColumn("ty", F.explode(touched("z")))


def tile_counts(points: DataFrame, zooms: range, low: float, side: float, margin_share: float) -> DataFrame:
    """(zoom, tx, ty, n): how many points each tile holds."""
    return tile_features(points.select("x", "z"), zooms, low, side, margin_share).groupBy("zoom", "tx", "ty").agg(F.count("*").alias("n"))
