"""Queries on clustered layouts, grids of several levels, scans in segments and total orders, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolyte.functions import tokens
from cartolyte.operators import layout, scans, spatial
from cartolyte.plans import exports, frame
from cartolyte.plans.catalogue import _PTS, _RECTS, _areas, _points, _table, query_into
from cartolyte.sources.shared import new_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_query = query_into(QUERIES, ORACLE_SQL)

#: What the clustered layout of the points covers.
SQUARE = layout.Square(-8192.0, -8192.0, 16384.0)

_CELL = "greatest(least(floor(({0} + 8192.0::DOUBLE) / 0.25::DOUBLE), 65535), 0)::BIGINT"
_MORTON = f"list_sum(list_transform(range(0, 16), lambda b: ((({_CELL.format('x')} >> b) & 1) << (2 * b)) + ((({_CELL.format('z')} >> b) & 1) << (2 * b + 1))))::BIGINT"


@_query("q61_viewport_layout", f"WITH {_PTS} SELECT vec_id, x, z, {_MORTON} AS morton FROM pts WHERE x BETWEEN -1500 AND 1700 AND z BETWEEN -1300 AND 1400 AND label <> 3")
def q61(spark: SparkSession, d: str) -> DataFrame:
    """The viewport of q01, from a table that is clustered for it."""
    path = new_path(spark, "clustered")
    layout.write_clustered(_points(spark, d), path, SQUARE)
    seen = layout.viewport(spark.read.parquet(path), SQUARE, -500, -300, 700, 400)
    return seen.where("label <> 3").select("vec_id", "x", "z", layout.KEY)


_WIDE = """wide AS (SELECT s_suppkey, s_suppkey AS seq, pow(10.0::DOUBLE, s_suppkey % 8) AS w, pow(10.0::DOUBLE, s_suppkey % 7) AS h, ((s_suppkey * 37 % 100 - 50) * 40.0::DOUBLE - pow(10.0::DOUBLE, s_suppkey % 8) / 3) AS rx, ((s_suppkey * 53 % 100 - 50) * 40.0::DOUBLE - pow(10.0::DOUBLE, s_suppkey % 7) / 3) AS rz FROM supplier)"""


def _wide(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    side = lambda n: F.pow(F.lit(10.0), k % n)
    low = lambda m, n: (k * m % 100 - 50) * 40.0 - side(n) / 3
    return _table(spark, d, "supplier").select("s_suppkey", k.alias("seq"), side(8).alias("w"), side(7).alias("h"), low(37, 8).alias("rx"), low(53, 7).alias("rz"))


@_query(
    "q62_rectangle_levels",
    f"WITH {_PTS}, {_WIDE}, f AS (SELECT vec_id, arg_min(s_suppkey, seq) AS first, arg_max(s_suppkey, seq) AS last FROM pts JOIN wide ON x >= rx AND x <= rx + w AND z >= rz AND z <= rz + h GROUP BY vec_id) SELECT vec_id, coalesce(first, -1) AS first, coalesce(last, -1) AS last FROM pts LEFT JOIN f USING (vec_id)",
)
def q62(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last rectangle that holds each point, of sides from 1 to ten million."""
    points, rects = _points(spark, d), _wide(spark, d)
    first = spatial.grid_join(points, rects, "vec_id", "s_suppkey", "seq", 600.0)
    last = spatial.grid_join(points, rects.withColumn("seq", -F.col("seq")), "vec_id", "s_suppkey", "seq", 600.0)
    pick = lambda df, name: df.select("vec_id", F.coalesce("s_suppkey", F.lit(-1)).alias(name))
    return pick(first, "first").join(pick(last, "last"), "vec_id")


@_query(
    "q63_segmented_scans",
    """SELECT event_id, coalesce(event_type <> lag(event_type) OVER w, true) AS starts_run, coalesce(lead(event_id) OVER w, -1) AS next_id,
              coalesce(sum((event_type = 'purchase')::INT) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block,
              coalesce(last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS seen
       FROM events WINDOW w AS (ORDER BY event_id)""",
)
def q63(spark: SparkSession, d: str) -> DataFrame:
    """Runs, next rows, blocks and carried values over all events as one sequence."""
    e, kind = _table(spark, d, "events").select("event_id", "event_type"), F.col("event_type")
    out = scans.scan(e, [], ["event_id"], before={"was": "event_type"}, after={"next_id": "event_id"}, blocks={"block": kind == "purchase"}, carried={"seen": F.when(kind == "view", F.col("event_id"))})
    return out.select("event_id", F.coalesce(kind != F.col("was"), F.lit(True)).alias("starts_run"), F.coalesce("next_id", F.lit(-1)).alias("next_id"), "block", F.coalesce("seen", F.lit(-1)).alias("seen"))


def _prefabs(spark: SparkSession, d: str) -> DataFrame:
    """A prefab for each region: a node, spawn points of many kinds, and runs of trigger points."""
    r = F.col("r_regionkey")
    real = lambda c: c.cast("float")
    node = F.struct(real(r).alias("x"), real(r * 2).alias("z"), real(F.lit(1)).alias("rot_x"), real(r).alias("rot_z"), F.lit(2).alias("lane_count"))
    kinds = F.array(*map(F.lit, (3, 4, exports.COMPANY_SPAWN, 7, 16, 1)))
    spawn = lambda i: F.struct(real(i * 3 + r).alias("x"), real(i - r).alias("z"), F.get(kinds, F.pmod(i + r, F.lit(6)).cast("int")).cast("long").alias("type"))
    park = F.lit(tokens.token_of(exports.PARKING_ACTION))
    trigger = lambda i: F.struct(F.floor((i + r) / 2).alias("trigger_id"), F.when((i + r) % 3 == 0, F.lit(6).cast("long")).otherwise(park).alias("action"), real(i).alias("x"), real(-i).alias("z"))
    upto = lambda n: F.sequence(F.lit(0), F.lit(n))
    point = F.struct(*(F.lit(0.0).cast("float").alias(c) for c in "xz"), *(F.lit(0).alias(c) for c in ("lane_count", "lane_offset")), F.lit(False).alias("hidden"), *(F.lit(0).alias(c) for c in ("color_flags", "control_node")), F.array(F.lit(0)).alias("neighbours"))
    return _table(spark, d, "region").select(
        F.concat(F.lit("p"), r).alias("path"), F.lit(True).alias("valid_road"), F.array(node).alias("nodes"), F.transform(upto(4), spawn).alias("spawn_points"), F.slice(F.array(point), 1, 0).alias("map_points"), F.transform(upto(5), trigger).alias("trigger_points")
    )


def _prefab_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "region").select(tokens.token(F.concat(F.lit("pre"), "r_regionkey")).alias("token"), F.concat(F.lit("p"), "r_regionkey").alias("path"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select(F.col("vec_id").alias("load_seq"), F.col("vec_id").alias("uid"), "x", "z", F.col("label").cast("double").alias("rotation"))


#: What the points are as items, by turns.
_KINDS = (frame.AREA, exports.PREFAB, exports.ROAD, exports.OVERLAY, exports.COMPANY, exports.TRIGGER, exports.FERRY, frame.CUTSCENE, exports.CITY, exports.BUS_STOP)


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Points as map items of ten kinds. A company belongs to the prefab three points before it, a road ends at the next point."""
    p, key, label = _points(spark, d), F.col("vec_id"), F.col("label")
    kind = F.get(F.array(*map(F.lit, _KINDS)), F.pmod(key, F.lit(10)).cast("int"))
    look = F.when(kind == exports.PREFAB, tokens.token(F.concat(F.lit("pre"), F.floor(key / 10) % 5))).when(kind == exports.FERRY, tokens.token(F.concat(F.lit("port"), label % 4))).otherwise(tokens.token(F.concat(F.lit("o"), label)))
    return p.select(
        key.alias("load_seq"), key.alias("uid"), kind.alias("type"), "x", "z", (label == 3).alias("hidden"), look.alias("look_token"), F.array(key).alias("nodes"), F.lit(0).alias("origin"), (key - 3).alias("prefab_uid"), key.alias("start_uid"),
        (key + 1).alias("end_uid"), (label % 2 == 0).alias("is_train"), (label % 2 == 1).alias("draw_over"), label.cast("int").alias("zoom_visibility"), F.array(F.lit(5).cast("long"), F.when(label < 5, F.lit(tokens.token_of(exports.PARKING_ACTION))).otherwise(F.lit(6).cast("long"))).alias("actions"),
    )


def _bitmaps(spark: SparkSession) -> DataFrame:
    names = [*("parking_ico", "train_ico", "port_overlay", "viewpoint", "gas_ico", "garage_large_ico", "dealer_ico", "recruitment_ico"), "o0", *(f"o{k}" for k in range(3, 10))]
    return spark.createDataFrame([(tokens.token_of(n), n, len(n) + 16, 8) for n in names], "token long, name string, width int, height int")


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    r, k = F.col("r_regionkey"), F.col("look_no")
    return _table(spark, d, "region").select("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("look_no")).select(F.concat(F.lit("p"), r).alias("path"), "look_no", (2 + (k + r) % 3).alias("z_index"))


def _ferries(spark: SparkSession, d: str) -> DataFrame:
    port = lambda c: tokens.token(F.concat(F.lit("port"), c))
    n = F.col("n_nationkey")
    return _table(spark, d, "nation").select(port(n % 5).alias("start_token"), port(n % 3).alias("end_token"), n.cast("long").alias("load_seq"))


#: The same in SQL: items, the spawn and the trigger points of prefabs with their icons.
_FRAME = f"""{_PTS}, i AS (SELECT *, vec_id % 10 AS k, (vec_id // 10) % 5 AS r, label = 3 AS hidden, x BETWEEN -3500 AND 3700 AND z BETWEEN -3300 AND 3400 AS inside FROM pts),
    sp AS (SELECT i.*, p, CASE (p + r) % 6 WHEN 0 THEN 'gas_ico' WHEN 1 THEN 'service_ico' WHEN 3 THEN 'dealer_ico' WHEN 4 THEN 'recruitment_ico' END AS icon FROM i, (SELECT unnest(range(0, 5)) AS p) WHERE k = 1),
    tr AS (SELECT i.*, p FROM i, (SELECT unnest(range(0, 6)) AS p) WHERE k = 1 AND (p = 0 OR (p + r) // 2 <> (p + r - 1) // 2) AND (p + r) % 3 <> 0)"""


@_query(
    "q64_frame_order",
    f"""WITH {_FRAME}, u AS (
          SELECT 0 AS layer, 0 AS z, 0::BIGINT AS load_seq, 0 AS kind, 0 AS part
          UNION ALL SELECT 1, 0, vec_id, 0, n_nationkey FROM i JOIN nation ON label % 4 = n_nationkey % 5 WHERE k = 6 AND NOT hidden
          UNION ALL SELECT 2, label % 2, vec_id, 0, 0 FROM i WHERE k = 0 AND inside AND NOT hidden
          UNION ALL SELECT 3, 2 + (q + r) % 3, vec_id, 0, q FROM i, (SELECT unnest(range(0, 3)) AS q) WHERE k = 1 AND inside AND NOT hidden
          UNION ALL SELECT 4, 0, vec_id, 0, 0 FROM i WHERE k = 2 AND inside AND NOT hidden AND vec_id + 1 IN (SELECT vec_id FROM pts)
          UNION ALL SELECT CASE k WHEN 3 THEN 5 ELSE 6 END, 0, vec_id, 0, 0 FROM i WHERE k IN (3, 4) AND inside AND NOT hidden AND label NOT IN (1, 2)
          UNION ALL SELECT 7, 0, vec_id, 0, p FROM sp WHERE inside AND NOT hidden AND icon IN ('gas_ico', 'dealer_ico', 'recruitment_ico')
          UNION ALL SELECT 7, 0, vec_id, 1, p FROM tr WHERE inside AND NOT hidden
          UNION ALL SELECT 8, 0, vec_id, 0, 0 FROM i WHERE k = 5 AND inside AND NOT hidden AND label < 5
          UNION ALL SELECT CASE k WHEN 6 THEN 9 ELSE 10 END, 0, vec_id, 0, 0 FROM i WHERE k IN (6, 7) AND inside
          UNION ALL SELECT 11, 0, vec_id, 0, 0 FROM i WHERE k = 8 AND NOT hidden)
        SELECT layer::INT AS layer, z::INT AS z, load_seq, kind::INT AS kind, part::INT AS part, row_number() OVER (ORDER BY layer, z, load_seq, kind, part)::BIGINT AS place FROM u""",
)
def q64(spark: SparkSession, d: str) -> DataFrame:
    """All twelve layers of a frame in one order."""
    return frame.drawn(_items(spark, d), _nodes(spark, d), _prefab_tokens(spark, d), _prefabs(spark, d), _shapes(spark, d), _ferries(spark, d), _bitmaps(spark), (-2500, -2300, 2700, 2400))


@_query(
    "q65_overlays_of_six_sources",
    f"""WITH {_FRAME}, {_RECTS}, c AS (SELECT vec_id, arg_min(s_suppkey, seq) AS city FROM pts JOIN rects ON x >= rx AND x <= rx + w AND z >= rz AND z <= rz + h GROUP BY vec_id),
             t AS (SELECT vec_id, p, icon AS name, CASE icon WHEN 'gas_ico' THEN 'Fuel' WHEN 'dealer_ico' THEN 'TruckDealer' ELSE 'Recruitment' END AS type, p * 3 + r AS px, p - r AS pz, x, z, r, label, hidden FROM sp WHERE icon IN ('gas_ico', 'dealer_ico', 'recruitment_ico')
                   UNION ALL SELECT vec_id, p, 'parking_ico', 'Parking', p, -p, x, z, r, label, hidden FROM tr
                   UNION ALL SELECT o.vec_id, 0, 'o' || o.label, 'Company', 3 * ((8 - i.r) % 6) + i.r, (8 - i.r) % 6 - i.r, i.x, i.z, i.r, i.label, o.hidden FROM i o JOIN i ON o.k = 4 AND i.vec_id = o.vec_id - 3 WHERE (8 - i.r) % 6 < 5),
             a AS (SELECT *, label - pi() - atan2(r, 1) + pi() / 2 AS angle FROM t),
             b AS (SELECT vec_id, name, type, x + (px - r) * cos(angle) - (pz - 2 * r) * sin(angle) AS x, z + (px - r) * sin(angle) + (pz - 2 * r) * cos(angle) AS z, -1 AS zoom, hidden FROM a),
             o AS (SELECT vec_id, 'o' || label AS name, 'Overlay' AS type, x, z, label AS zoom, hidden FROM i WHERE k = 3
                   UNION ALL SELECT vec_id, 'parking_ico', 'Parking', x, z, -1, hidden FROM i WHERE k = 5 AND label < 5
                   UNION ALL SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'train_ico' ELSE 'port_overlay' END, CASE WHEN label % 2 = 0 THEN 'Train' ELSE 'Ferry' END, x, z, -1, hidden FROM i WHERE k = 6
                   UNION ALL SELECT o.vec_id, 'o' || o.label, 'Company', o.x, o.z, -1, o.hidden FROM i o JOIN i ON o.k = 4 AND i.vec_id = o.vec_id - 3 WHERE (8 - i.r) % 6 >= 5
                   UNION ALL SELECT * FROM b)
        SELECT round(x, 3) AS "X", round(z, 3) AS "Y", zoom::BIGINT AS "ZoomLevelVisibility", name AS "Name", type AS "Type", 16 + length(name) AS "Width", CASE WHEN city IS NULL THEN 'none' WHEN city % 2 = 0 THEN 'S' || city || ' EN' ELSE 'S' || city END AS "City"
        FROM o LEFT JOIN c USING (vec_id) WHERE NOT hidden AND name NOT IN ('o1', 'o2')""",
)
def q65(spark: SparkSession, d: str) -> DataFrame:
    """The export of all six sources of overlays."""
    out = exports.overlay_rows(_items(spark, d), _prefab_tokens(spark, d), _prefabs(spark, d), _nodes(spark, d), _areas(spark, d), _bitmaps(spark))
    real = lambda c: F.round(c, 3).alias(c)
    return out.select(real("X"), real("Y"), F.coalesce(F.col("ZoomLevelVisibility").cast("long"), F.lit(-1)).alias("ZoomLevelVisibility"), "Name", "Type", F.col("Width").cast("long").alias("Width"), F.coalesce("City.Name", F.lit("none")).alias("City"))


def _countries(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("r_regionkey")
    names = F.when(r % 2 == 0, F.create_map(F.lit("en_us"), F.concat("r_name", F.lit(" EN"))))
    return _table(spark, d, "region").select(
        tokens.token(F.concat(F.lit("r"), r)).alias("token"), r.alias("country_id"), F.col("r_name").alias("name"), F.upper(F.left("r_name", F.lit(2))).alias("country_code"), (r * 1.5).cast("double").alias("x"), (10 - r * 2.0).cast("double").alias("y"), names.alias("localized_names")
    )


@_query(
    "q66_city_export",
    f"""WITH {_PTS} SELECT n_name AS "Name", 'loc' || n_nationkey AS "LocalizationToken", 'r' || (n_regionkey + n_nationkey % 2) AS "Country", round(x, 3) AS "X", round(z, 3) AS "Y", coalesce(r_regionkey, -1)::INT AS "CountryId", CASE WHEN n_nationkey % 3 = 0 THEN n_name || ' EN' ELSE 'none' END AS "Localized"
        FROM pts JOIN nation ON label = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey + n_nationkey % 2 WHERE vec_id % 10 = 8 AND label <> 3""",
)
def q66(spark: SparkSession, d: str) -> DataFrame:
    """The export of city items: those of unknown countries have no country number."""
    key = F.col("n_nationkey")
    names = F.when(key % 3 == 0, F.create_map(F.lit("en_us"), F.concat("n_name", F.lit(" EN"))))
    known = _table(spark, d, "nation").select(
        tokens.token(F.concat(F.lit("o"), key)).alias("token"), F.col("n_name").alias("name"), F.concat(F.lit("loc"), key).alias("loc_token"), F.concat(F.lit("r"), F.col("n_regionkey") + key % 2).alias("country"), names.alias("localized_names")
    )
    out = exports.cities(_items(spark, d).where(F.col("type") == exports.CITY), known, _countries(spark, d))
    localized = F.coalesce(F.try_element_at("LocalizedNames", F.lit("en_us")), F.lit("none"))
    return out.select("Name", "LocalizationToken", "Country", F.round("X", 3).alias("X"), F.round("Y", 3).alias("Y"), F.coalesce("CountryId", F.lit(-1)).alias("CountryId"), localized.alias("Localized"))


@_query("q67_country_export", """SELECT r_regionkey AS "CountryId", r_name AS "Name", upper(left(r_name, 2)) AS "CountryCode", (r_regionkey * 1.5)::DOUBLE AS "X", (10 - r_regionkey * 2.0)::DOUBLE AS "Y", CASE WHEN r_regionkey % 2 = 0 THEN '{"en_us":"' || r_name || ' EN"}' ELSE '{}' END AS "LocalizedNames" FROM region""")
def q67(spark: SparkSession, d: str) -> DataFrame:
    """The export of countries."""
    return exports.countries(_countries(spark, d)).withColumn("LocalizedNames", F.coalesce(F.to_json("LocalizedNames"), F.lit("{}")))


@_query(
    "q68_tile_map_info",
    f"""WITH {_PTS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1, greatest(max(x) - min(x), max(z) - min(z)) AS side FROM pts)
        SELECT (x0 + x1 - side) / 2 AS x1, (x0 + x1 - side) / 2 + side AS x2, (z0 + z1 - side) / 2 AS y1, (z0 + z1 - side) / 2 + side AS y2, 0 AS "minZoom", 8 AS "maxZoom" FROM b""",
)
def q68(spark: SparkSession, d: str) -> DataFrame:
    """The description of the tile pyramid."""
    return exports.tile_map_rows(_points(spark, d), 0, 8)
