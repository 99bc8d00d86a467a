"""What a frame of the map shows, in the order in which it is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolyte.functions.tokens import token_of
from cartolyte.operators import lookup, scans
from cartolyte.operators.spatial import MARGIN, in_viewport
from cartolyte.plans import exports

#: Layers from the first drawn to the last, with the bit that turns each on; 0 is always on (fixed values).
LAYERS = {
    "background": 0,
    "ferry_lines": 32,
    "areas": 8,
    "prefabs": 2,
    "roads": 4,
    "overlays": 16,
    "companies": 16,
    "prefab_icons": 16,
    "triggers": 16,
    "ferry_icons": 16,
    "viewpoints": 16,
    "city_names": 64,
}
#: Types that only a frame shows, and the icon of a viewpoint (fixed values).
AREA, CUTSCENE, VIEWPOINT = 42, 46, "viewpoint"
#: All bits.
ALL = 0x7FFFFFFF

_ORDER = ["layer", "z", "load_seq", "kind", "part"]


def _number(layer: str) -> int:
    return list(LAYERS).index(layer)


def _rows(df: DataFrame, layer: Column, z=0, kind: int = 0, part=0, token=None) -> DataFrame:
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    return df.select(
        layer.cast("int").alias("layer"), as_column(z).cast("int").alias("z"), F.col("load_seq").cast("long").alias("load_seq"), F.lit(kind).alias("kind"), as_column(part).cast("int").alias("part"), as_column(token).cast("long").alias("token")
    )


def own_layer(inside: Column) -> Column:
    """The layer of an item that stands for itself, null if it isn't drawn: most are left out outside the viewport or if hidden, ferries' and viewpoints' icons only outside, cities only if hidden."""
    kind, shown = F.col("type"), inside & ~F.col("hidden")
    chosen = F
    for code, layer, condition in (
        (AREA, "areas", shown),
        (exports.OVERLAY, "overlays", shown),
        (exports.COMPANY, "companies", shown),
        (exports.TRIGGER, "triggers", shown & exports.is_parking(F.col("actions"))),
        (exports.FERRY, "ferry_icons", inside),
        (CUTSCENE, "viewpoints", inside),
        (exports.CITY, "city_names", ~F.col("hidden")),
    ):
        chosen = chosen.when((kind == code) & condition, _number(layer))
    return chosen.otherwise(None)


def own_icon() -> Column:
    """The token of the bitmap that an item's drawing needs, null if it needs none."""
    kind = F.col("type")
    ferry = F.when(F.coalesce("is_train", F.lit(False)), F.lit(token_of("train_ico"))).otherwise(F.lit(token_of("port_overlay")))
    icons = F.when(kind.isin(exports.OVERLAY, exports.COMPANY), F.col("look_token")).when(kind == exports.TRIGGER, F.lit(token_of("parking_ico")))
    return icons.when(kind == exports.FERRY, ferry).when(kind == CUTSCENE, F.lit(token_of(VIEWPOINT)))


def drawn(
    items: DataFrame, nodes: DataFrame, prefab_definitions: DataFrame, prefabs: DataFrame, shapes: DataFrame, connections: DataFrame, bitmaps: DataFrame,
    view: tuple[float, float, float, float], bits: int = ALL, margin: float = MARGIN, stretches: int | None = None,
) -> DataFrame:
    """layer, z, load_seq, kind, part, place: all that is drawn for a viewport (x0, z0, x1, z1), by its place from 1 on.

    A layer's rows are in the order of loading, but areas by whether they are drawn over others and prefabs' shapes by
    their z index first. ``load_seq`` is the item's; ``part`` numbers a prefab's shapes, spawn points (kind 0) and trigger
    points (kind 1), and a port's ferry lines. Icons without a bitmap aren't drawn. ``shapes`` has (path, look_no,
    z_index), ``connections`` (start_token, end_token, load_seq).

    The prefabs in view have two readers, their shapes and their icons; they are persisted until the caller clears Spark's cache.
    """
    inside = in_viewport(F.col("x"), F.col("z"), *view, margin)
    on = [i for i, bit in enumerate(LAYERS.values()) if flags_on(bits, bit)]
    seen = exports.prefab_frames(items.where((F.col("type") == exports.PREFAB) & inside & ~F.col("hidden")), prefab_definitions, prefabs, nodes).persist()

    background = _rows(items.sparkSession.range(1).select(F.lit(0).alias("load_seq")), F.lit(_number("background")))
    ports = items.where((F.col("type") == exports.FERRY) & ~F.col("hidden")).select("load_seq", F.col("look_token").alias("port_token"))
    lines = lookup.connections_from(ports, connections.select("start_token", F.col("load_seq").alias("line_seq")))
    roads = lookup.with_ends(items.where((F.col("type") == exports.ROAD) & inside & ~F.col("hidden")).select("load_seq", "start_uid", "end_uid"), nodes.select("uid"), "start_uid", "end_uid")
    own = items.withColumn("layer", own_layer(inside)).where("layer IS NOT NULL")
    spawns, parks = exports.spawn_overlays(seen), exports.trigger_overlays(seen)
    icons = F.lit(_number("prefab_icons"))

    parts = [
        background,
        _rows(lines, F.lit(_number("ferry_lines")), part=F.col("line_seq")),
        _rows(seen.join(shapes, "path"), F.lit(_number("prefabs")), z=F.col("z_index"), part=F.col("look_no")),
        _rows(roads, F.lit(_number("roads"))),
        _rows(own, F.col("layer"), z=F.when(F.col("type") == AREA, F.coalesce(F.col("draw_over"), F.lit(False)).cast("int")).otherwise(0), token=own_icon()),
        _rows(spawns, icons, part=F.col("part"), token=F.col("token")),
        _rows(parks, icons, kind=1, part=F.col("part"), token=F.col("token")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    known = bitmaps.select("token").distinct().withColumn("_known", F.lit(True))
    rows = rows.where(F.col("layer").isin(*on)).join(known, "token", "left").where(F.col("token").isNull() | F.col("_known")).drop("token", "_known")
    return scans.total_places(rows, _ORDER, stretches=stretches)


def flags_on(bits: int, bit: int) -> bool:
    return bits & bit == bit

