"""The query catalogue: the operators of map data over the driver's tables, each with its DuckDB form.

Points are the first two components of ``embeddings``; rectangles derive from ``supplier``. Trigonometric results are
rounded, as the engines' last digits differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolyte.functions import geometry, strings, tokens
from cartolyte.operators import flags, lookup, precedence, runs, spatial
from cartolyte.plans import exports
from cartolyte.schemas import NODES, PREFABS
from cartolyte.sources import definitions, tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    part = lambda i: F.get("embedding", F.lit(i)).cast("double") * 10000.0
    return e.select("vec_id", part(0).alias("x"), part(1).alias("z"), F.col("label").cast("long").alias("label"))


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(
        "s_suppkey", k.alias("seq"), ((k * 37 % 40 - 20) * 100.0).alias("rx"), ((k * 53 % 40 - 20) * 100.0).alias("rz"), F.lit(700.0).alias("w"), F.lit(500.0).alias("h")
    )


_PTS = "pts AS (SELECT vec_id, embedding[1]::DOUBLE * 10000.0::DOUBLE AS x, embedding[2]::DOUBLE * 10000.0::DOUBLE AS z, label::BIGINT AS label FROM embeddings)"
_RECTS = "rects AS (SELECT s_suppkey, s_suppkey AS seq, (s_suppkey * 37 % 40 - 20) * 100.0::DOUBLE AS rx, (s_suppkey * 53 % 40 - 20) * 100.0::DOUBLE AS rz, 700.0::DOUBLE AS w, 500.0::DOUBLE AS h FROM supplier)"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query_into(queries: dict, oracle: dict[str, str]):
    """A decorator that enters a query and its SQL by name."""

    def query(name: str, sql: str):
        def add(f):
            queries[name], oracle[name] = f, sql
            return f

        return add

    return query


_query = query_into(QUERIES, ORACLE_SQL)


@_query("q01_viewport_filter", f"WITH {_PTS} SELECT vec_id, x, z FROM pts WHERE x >= -500 - 1000 AND x <= 700 + 1000 AND z >= -300 - 1000 AND z <= 400 + 1000 AND NOT (label = 3)")
def q01(spark, d):
    p = _points(spark, d)
    return p.where(spatial.in_viewport(F.col("x"), F.col("z"), -500, -300, 700, 400) & (F.col("label") != 3)).select("vec_id", "x", "z")


@_query("q02_viewport_with_hidden", f"WITH {_PTS} SELECT vec_id, x, z FROM pts WHERE x BETWEEN -1500 AND 1700 AND z BETWEEN -1300 AND 1400")
def q02(spark, d):
    return _points(spark, d).where(spatial.in_viewport(F.col("x"), F.col("z"), -500, -300, 700, 400)).select("vec_id", "x", "z")


@_query(
    "q03_hidden_flag",
    """SELECT l_orderkey, l_linenumber, (l_partkey % 25)::BIGINT > 12 OR (l_linenumber & 2) <> 0 AS hidden_road, (l_partkey % 25) > 12 OR l_suppkey = 255 AS hidden_overlay, (l_linenumber & 1) <> 0 AS hidden_city
       FROM lineitem""",
)
def q03(spark, d):
    l, guard = _table(spark, d, "lineitem"), F.col("l_partkey") % 25
    n = F.col("l_linenumber")
    return l.select("l_orderkey", "l_linenumber", flags.hidden_road(guard, n).alias("hidden_road"), flags.hidden_overlay(guard, F.col("l_suppkey")).alias("hidden_overlay"), flags.hidden_city(n).alias("hidden_city"))


@_query("q04_flag_mask_all", "SELECT m, count(*) AS n FROM lineitem, (VALUES (1), (2), (3), (6)) t(m) WHERE (l_linenumber & m) = m GROUP BY m")
def q04(spark, d):
    masks = F.filter(F.array(*map(F.lit, (1, 2, 3, 6))), lambda m: flags.has_all(F.col("l_linenumber"), m))
    return _table(spark, d, "lineitem").select(F.explode(masks).alias("m")).groupBy("m").agg(F.count("*").alias("n"))


@_query(
    "q05_enum_map",
    """WITH p AS (SELECT p_partkey, p_size & 15 AS c FROM part), n AS (
         SELECT p_partkey, CASE c WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 6 WHEN 4 THEN 8 WHEN 5 THEN 5 WHEN 6 THEN 7 WHEN 8 THEN 3 WHEN 13 THEN -1 WHEN 14 THEN -2 ELSE 1 END AS lanes,
                CASE c WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 5 WHEN 4 THEN 10 WHEN 5 THEN 15 WHEN 6 THEN 20 WHEN 7 THEN 25 ELSE 0 END AS lane_offset,
                CASE c WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 8 THEN 3 ELSE -1 END AS control_node FROM p)
       SELECT p_partkey, lanes, lane_offset, control_node, CASE WHEN lanes <> -2 THEN lanes ELSE coalesce(nullif(control_node, -1), 1) END AS used_lanes FROM n""",
)
def q05(spark, d):
    c = F.col("p_size").bitwiseAND(F.lit(15))
    out = _table(spark, d, "part").select("p_partkey", flags.mapped(c, flags.LANES, 1).alias("lanes"), flags.mapped(c, flags.LANE_OFFSETS, 0).alias("lane_offset"), flags.mapped(c, flags.CONTROL_NODES, -1).alias("control_node"))
    return out.withColumn("used_lanes", flags.lane_count(F.col("lanes"), F.nullif("control_node", F.lit(-1)), F.col("lanes")))


@_query(
    "q06_colour_priority",
    "SELECT CASE WHEN l_linenumber & 1 = 1 THEN 'light' WHEN l_linenumber & 2 = 2 THEN 'dark' WHEN l_linenumber & 3 = 3 THEN 'green' ELSE 'none' END AS colour, count(*) AS n FROM lineitem GROUP BY 1",
)
def q06(spark, d):
    colour = flags.first_colour(F.col("l_linenumber"), [(1, "light"), (2, "dark"), (3, "green")], "none")
    return _table(spark, d, "lineitem").groupBy(colour.alias("colour")).agg(F.count("*").alias("n"))


@_query(
    "q07_city_country_left",
    "SELECT c_custkey, coalesce(n_name, 'none') AS country, coalesce(r_name, 'none') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 4 <> 1 LEFT JOIN region ON n_regionkey = r_regionkey",
)
def q07(spark, d):
    nation = _table(spark, d, "nation").where("n_nationkey % 4 <> 1")
    out = _table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", F.coalesce("n_name", F.lit("none")).alias("country"), F.coalesce("r_name", F.lit("none")).alias("region"))


@_query("q08_definition_inner", "SELECT p_type, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 20 GROUP BY p_type")
def q08(spark, d):
    parts = _table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return lookup.with_definition(_table(spark, d, "lineitem"), parts, "l_partkey").groupBy("p_type").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@_query(
    "q09_two_node_join",
    f"""WITH {_PTS} SELECT o_orderkey, round(a.x, 4) AS x0, round(a.z, 4) AS z0, round(b.x, 4) AS x1, round(b.z, 4) AS z1
        FROM orders JOIN pts a ON o_orderkey % 500 = a.vec_id JOIN pts b ON o_custkey % 700 = b.vec_id""",
)
def q09(spark, d):
    nodes = _points(spark, d).withColumnRenamed("vec_id", "uid")
    roads = _table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 500).alias("a"), (F.col("o_custkey") % 700).alias("b"))
    at = lambda c, name: F.round(c, 4).alias(name)
    return lookup.with_ends(roads, nodes, "a", "b").select("o_orderkey", at("start.x", "x0"), at("start.z", "z0"), at("end.x", "x1"), at("end.z", "z1"))


@_query(
    "q10_ordered_points",
    f"""WITH {_PTS}, u AS (SELECT l_orderkey, l_linenumber, l_partkey % 600 AS uid FROM lineitem)
        SELECT l_orderkey, string_agg(vec_id::VARCHAR, ',' ORDER BY l_linenumber, vec_id) AS path, count(*) AS n FROM u JOIN pts ON uid = vec_id GROUP BY l_orderkey""",
)
def q10(spark, d):
    items = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 600).alias("uid")))).alias("l")).select("l_orderkey", F.col("l.uid").alias("uids"))
    nodes = _points(spark, d).select(F.col("vec_id").alias("uid"), F.col("vec_id").alias("x"), "z")
    points = lookup.ordered_points(items, nodes, "l_orderkey", "uids")
    return points.select("l_orderkey", F.array_join(F.transform("points", lambda p: p["x"].cast("string")), ",").alias("path"), F.size("points").cast("long").alias("n"))


@_query(
    "q11_first_match_left",
    "SELECT o_orderkey, coalesce(l_partkey, -1) AS l_partkey, coalesce(l_linenumber, -1) AS l_linenumber FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 25 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1) ON o_orderkey = l_orderkey",
)
def q11(spark, d):
    lines = _table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", F.struct("l_linenumber", "l_partkey").alias("load_seq"))
    out = lookup.first_match(_table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", "load_seq")
    return out.select("o_orderkey", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("l_partkey", "l_linenumber")))


@_query(
    "q12_first_in_array",
    "SELECT vec_id, (list_position(list_transform(embedding, lambda v: v > 0.2), true))::BIGINT AS pos, round(list_filter(embedding, lambda v: v > 0.2)[1], 5)::DOUBLE AS v FROM embeddings WHERE len(list_filter(embedding, lambda v: v > 0.2)) > 0",
)
def q12(spark, d):
    big = lambda v: v > 0.2
    e = _table(spark, d, "embeddings").where(F.exists("embedding", big))
    return e.select("vec_id", F.array_position(F.transform("embedding", big), F.lit(True)).cast("long").alias("pos"), F.round(lookup.first_item(F.col("embedding"), big), 5).cast("double").alias("v"))


_CITY = f"WITH {_PTS}, {_RECTS} SELECT vec_id, arg_min(s_suppkey, seq) AS s_suppkey FROM pts LEFT JOIN rects ON x >= rx AND x <= rx + w AND z >= rz AND z <= rz + h GROUP BY vec_id"
_CITY = f"SELECT vec_id, coalesce(s_suppkey, -1) AS s_suppkey FROM ({_CITY})"


@_query("q13_poi_city_range", _CITY)
def q13(spark, d):
    return spatial.grid_join(_points(spark, d), _rects(spark, d), "vec_id", "s_suppkey", "seq", 1500.0).select("vec_id", F.coalesce("s_suppkey", F.lit(-1)).alias("s_suppkey"))


@_query("q14_poi_city_grid", _CITY)
def q14(spark, d):
    return spatial.grid_join(_points(spark, d), _rects(spark, d), "vec_id", "s_suppkey", "seq", 600.0).select("vec_id", F.coalesce("s_suppkey", F.lit(-1)).alias("s_suppkey"))


@_query(
    "q15_port_connections",
    """WITH c AS (SELECT n_nationkey AS s, (n_nationkey * n_regionkey + 3) % 25 AS e FROM nation),
            p AS (SELECT s_nationkey AS port, s_suppkey AS x, s_suppkey * 2 AS z FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) = 1)
       SELECT s AS start_token, e AS end_token, coalesce(a.x, -1) AS start_x, coalesce(a.z, -1) AS start_z, CASE WHEN s <> e THEN coalesce(b.x, -1) ELSE -1 END AS end_x, CASE WHEN s <> e THEN coalesce(b.z, -1) ELSE -1 END AS end_z
       FROM c LEFT JOIN p a ON s = a.port LEFT JOIN p b ON e = b.port""",
)
def q15(spark, d):
    c = _table(spark, d, "nation").select(F.col("n_nationkey").alias("start_token"), ((F.col("n_nationkey") * F.col("n_regionkey") + 3) % 25).alias("end_token"))
    ports = _table(spark, d, "supplier").select(F.col("s_nationkey").alias("port_token"), F.col("s_suppkey").alias("x"), (F.col("s_suppkey") * 2).alias("z"), F.col("s_suppkey").alias("load_seq"))
    places = ("start_x", "start_z", "end_x", "end_z")
    return lookup.port_ends(c, ports).select("start_token", "end_token", *(F.coalesce(p, F.lit(-1)).alias(p) for p in places))


@_query(
    "q16_localized_name",
    """WITH l AS (SELECT r_regionkey AS k, 'loc' || (r_regionkey % 2) AS locale, lower(r_name) AS name, r_regionkey AS seq FROM region UNION ALL SELECT r_regionkey, 'loc0', 'later', r_regionkey + 100 FROM region),
            f AS (SELECT k, locale, arg_min(name, seq) AS name FROM l GROUP BY k, locale)
       SELECT n_nationkey, coalesce(f.name, n_name) AS name FROM nation LEFT JOIN f ON n_regionkey = f.k AND f.locale = 'loc0'""",
)
def q16(spark, d):
    r = _table(spark, d, "region")
    own = r.select("r_regionkey", F.concat(F.lit("loc"), F.col("r_regionkey") % 2).alias("locale"), F.lower("r_name").alias("name"), F.col("r_regionkey").alias("seq"))
    later = r.select("r_regionkey", F.lit("loc0").alias("locale"), F.lit("later").alias("name"), (F.col("r_regionkey") + 100).alias("seq"))
    first = precedence.first_wins(own.unionByName(later), ["r_regionkey", "locale"], "seq")
    names = first.groupBy("r_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("locale", "name"))).alias("names"))
    out = _table(spark, d, "nation").join(names, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("n_nationkey", strings.localised(F.col("names"), "loc0", F.col("n_name")).alias("name"))


@_query("q17_mods_anti", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def q17(spark, d):
    used = _table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return lookup.without(_table(spark, d, "part").select("p_partkey", "p_name"), used, "p_partkey")


@_query(
    "q18_sii_parse_counts",
    r"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '^([^ ]*) ', '\1: ') AS line FROM documents), t AS (SELECT doc_id, line, regexp_replace(line, '^[^!-~]+|[^!-~]+$', '', 'g') AS bare FROM l),
             v AS (SELECT doc_id, regexp_replace(split_part(bare, ':', 1), '^[^!-~]+|[^!-~]+$', '', 'g') AS k, regexp_replace(split_part(bare, ':', 2), '^[^!-~]+|[^!-~]+$', '', 'g') AS raw FROM t WHERE contains(bare, ':') AND NOT starts_with(bare, '#') AND NOT starts_with(bare, '//')),
             w AS (SELECT doc_id, k, CASE WHEN contains(raw, '//') THEN regexp_replace(left(raw, length(raw) - strpos(reverse(raw), '//') - 1), '^[^!-~]+|[^!-~]+$', '', 'g') ELSE raw END AS v FROM v)
        SELECT doc_id, count(*) AS lines, count(DISTINCT k) AS keys, sum(length(k) + length(v))::BIGINT AS chars, count(nullif(split_part(v, '"', 2), '')) AS quoted FROM w GROUP BY doc_id""",
)
def q18(spark, d):
    # The texts hold hardly a colon, so the first blank of a line stands for one.
    line = F.regexp_replace("line", "^([^ ]*) ", "$1: ")
    lines = _table(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    keyed = lines.where(~strings.is_comment(line)).select("doc_id", strings.line_key(line).alias("k"), strings.line_value(line).alias("v")).where("k IS NOT NULL")
    return keyed.groupBy("doc_id").agg(F.count("*").alias("lines"), F.countDistinct("k").alias("keys"), F.sum(F.length("k") + F.length("v")).alias("chars"), F.count(F.nullif(strings.quoted(F.col("v")), F.lit(""))).alias("quoted"))


@_query("q19_map_bounds", f"WITH {_PTS} SELECT min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z FROM pts")
def q19(spark, d):
    return spatial.bounds(_points(spark, d))


@_query(
    "q20_lane_count",
    "SELECT vec_id, len(list_filter(embedding, lambda v: v > 0))::BIGINT AS lanes, (1.5 + 4.5 * len(list_filter(embedding, lambda v: v > 0)) + 4.5 * len(list_filter(embedding, lambda v: v < -0.1)))::DOUBLE AS width FROM embeddings",
)
def q20(spark, d):
    left, right = F.filter("embedding", lambda v: v > 0), F.filter("embedding", lambda v: v < -0.1)
    return _table(spark, d, "embeddings").select("vec_id", F.size(left).cast("long").alias("lanes"), geometry.road_width(F.lit(1.5), left, right).alias("width"))


@_query(
    "q21_draw_order",
    f"WITH {_PTS} SELECT vec_id, label % 3 AS layer, row_number() OVER (PARTITION BY label % 3 ORDER BY label, vec_id)::BIGINT AS place FROM pts",
)
def q21(spark, d):
    return runs.places(_points(spark, d).withColumn("layer", F.col("label") % 3), ["layer"], ["label"], "vec_id").select("vec_id", "layer", "place")


@_query(
    "q22_tile_cover",
    f"""WITH {_PTS}, t AS (SELECT z::BIGINT AS zoom, i::BIGINT AS tx, j::BIGINT AS ty, 8000.0::DOUBLE / (1 << z) AS step FROM (SELECT unnest(range(0, 3)) AS z), (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j) WHERE i < (1 << z) AND j < (1 << z))
        SELECT zoom::INT AS zoom, tx, ty, count(*) AS n FROM t JOIN pts ON x >= -4000 + tx * step - step / 8 AND x <= -4000 + (tx + 1) * step + step / 8 AND pts.z >= -4000 + ty * step - step / 8 AND pts.z <= -4000 + (ty + 1) * step + step / 8 GROUP BY 1, 2, 3""",
)
def q22(spark, d):
    return spatial.tile_counts(_points(spark, d), range(3), -4000.0, 8000.0, 0.125)


_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz_"


#: A token in SQL: the digits from the last to the first, each step modulo 2**64, then as a signed number.
_TOKEN = f"(SELECT CASE WHEN t >= 9223372036854775808::HUGEINT THEN t - 18446744073709551616::HUGEINT ELSE t END::BIGINT FROM (SELECT list_reduce(list_prepend(0::HUGEINT, list_transform(range(length({{0}}), 0, -1), lambda i: instr('{_DIGITS}', lower(substr({{0}}, i, 1)))::HUGEINT)), lambda a, c: (a * 38 + c) % 18446744073709551616::HUGEINT) AS t))"


@_query(
    "q23_token_encode",
    f"WITH n AS (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT p_name FROM part UNION ALL SELECT unnest(['hud_parking', 'weigh_station_ico', 'recruitment_ico'])) SELECT name, {_TOKEN.format('name')} AS token FROM n",
)
def q23(spark, d):
    column = lambda table, c: _table(spark, d, table).select(F.col(c).alias("name"))
    fixed = spark.range(1).select(F.explode(F.array(*map(F.lit, ("hud_parking", "weigh_station_ico", "recruitment_ico")))).alias("name"))
    names = column("nation", "n_name").unionByName(column("region", "r_name")).unionByName(column("part", "p_name")).unionByName(fixed)
    return names.select("name", tokens.token(F.col("name")).alias("token"))


@_query(
    "q24_path_parts",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
        SELECT page_id, regexp_extract(path, '[^/]*$') AS name, split_part(regexp_extract(path, '[^/]*$'), '.', 1) AS stem, regexp_replace(path, '/?[^/]*$', '') AS dir,
               CASE WHEN contains(regexp_extract(path, '[^/]*$'), '.') THEN regexp_extract(path, '[^./]*$') ELSE '' END AS ext, 'def/' || path AS combined FROM p""",
)
def q24(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    p = _table(spark, d, "pages").select("page_id", path.alias("path"))
    c = F.col("path")
    return p.select("page_id", strings.file_name(c).alias("name"), strings.stem(c).alias("stem"), strings.directory(c).alias("dir"), strings.extension(c).alias("ext"), strings.combine_path(F.lit("def"), c).alias("combined"))


@_query(
    "q25_export_union",
    f"""WITH {_PTS} SELECT round(x, 3) AS x, round(z, 3) AS y, 'Overlay' AS type, label::BIGINT AS visibility FROM pts
        UNION ALL SELECT s_suppkey::DOUBLE, s_nationkey::DOUBLE, 'Company', -1 FROM supplier UNION ALL SELECT n_nationkey::DOUBLE, n_regionkey::DOUBLE, 'Ferry', -1 FROM nation""",
)
def q25(spark, d):
    overlays = _points(spark, d).select(F.round("x", 3).alias("x"), F.round("z", 3).alias("y"), F.lit("Overlay").alias("type"), F.col("label").alias("visibility"))
    place = lambda name, a, b, kind: _table(spark, d, name).select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"), F.lit(kind).alias("type"))
    both = overlays.unionByName(place("supplier", "s_suppkey", "s_nationkey", "Company"), allowMissingColumns=True).unionByName(place("nation", "n_nationkey", "n_regionkey", "Ferry"), allowMissingColumns=True)
    return both.withColumn("visibility", F.coalesce("visibility", F.lit(-1)))


@_query(
    "q26_layer_last_wins",
    "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'mod ' || p_name ELSE p_name END AS p_name, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS layer FROM part",
)
def q26(spark, d):
    order = precedence.layer_order(["mod", "base"])
    part = _table(spark, d, "part").select("p_partkey", "p_name")
    mod = part.where("p_partkey % 5 = 0").withColumn("p_name", F.concat(F.lit("mod "), "p_name"))
    return precedence.last_wins(mod.withColumn("layer", F.lit(order["mod"])).unionByName(part.withColumn("layer", F.lit(order["base"]))), ["p_partkey"], "layer")


@_query("q27_first_wins", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def q27(spark, d):
    return precedence.first_wins(_table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@_query("q28_pair_dedupe", "SELECT least(l_suppkey, l_partkey % 10) AS lo, greatest(l_suppkey, l_partkey % 10) AS hi, min(l_orderkey * 8 + l_linenumber) AS seq FROM lineitem GROUP BY 1, 2")
def q28(spark, d):
    pairs = _table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 10).alias("b"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    return precedence.one_per_pair(pairs, "a", "b", "seq").select("lo", "hi", "seq")


@_query(
    "q29_run_dedupe_then_filter",
    "SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE (b IS NULL OR b <> event_type) AND event_type = 'view'",
)
def q29(spark, d):
    e = _table(spark, d, "events").select("event_id", "user_id", "event_type")
    return runs.run_starts(e, ["user_id"], ["event_id"], "event_type").where("event_type = 'view'").select("event_id", "user_id")


@_query(
    "q30_positional_pick",
    "SELECT * FROM (SELECT user_id, event_id, coalesce(try_cast(substr(event_type, 1, 1) AS INT), -1) AS digit, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS pos FROM events) WHERE pos BETWEEN 5 AND 8",
)
def q30(spark, d):
    e = _table(spark, d, "events").select("user_id", "event_id", F.coalesce(strings.safe_int(F.substring("event_type", 1, 1)), F.lit(-1)).alias("digit"))
    return runs.positions(e, ["user_id"], ["event_id"], 5, 8)


_NEXT = f"WITH {_PTS}, n AS (SELECT *, lead(x) OVER w AS nx, lead(z) OVER w AS nz FROM pts WINDOW w AS (PARTITION BY vec_id // 16 ORDER BY vec_id)), s AS (SELECT * FROM n WHERE nx IS NOT NULL)"


def _segments(spark, d):
    lines = _points(spark, d).withColumn("line", F.floor(F.col("vec_id") / 16))  # of sixteen points each
    return runs.with_next(lines, ["line"], ["vec_id"], ["x", "z"]).where("next_x IS NOT NULL")


@_query(
    "q31_adjacent_bezier",
    f"""{_NEXT} SELECT vec_id, round(x + cos(atan2(nz - z, nx - x)) * sqrt((nx - x) * (nx - x) + (nz - z) * (nz - z)) / 3, 3) AS cx, round(z + sin(atan2(nz - z, nx - x)) * sqrt((nx - x) * (nx - x) + (nz - z) * (nz - z)) / 3, 3) AS cz FROM s""",
)
def q31(spark, d):
    dx, dz = F.col("next_x") - F.col("x"), F.col("next_z") - F.col("z")
    ox, oz = geometry.control_offset(dx, dz, F.atan2(dz, dx))
    return _segments(spark, d).select("vec_id", F.round(F.col("x") + ox, 3).alias("cx"), F.round(F.col("z") + oz, 3).alias("cz"))


@_query(
    "q32_block_parser",
    """WITH b AS (SELECT user_id, event_id, event_type, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block,
                      last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM events)
       SELECT user_id, block, count(*) AS lines, coalesce(max(seen), -1) AS last_view FROM b GROUP BY user_id, block""",
)
def q32(spark, d):
    e = _table(spark, d, "events").select("user_id", "event_id", "event_type")
    e = runs.with_block(e, ["user_id"], ["event_id"], F.col("event_type") == "purchase")
    e = runs.carried(e, ["user_id"], ["event_id"], F.when(F.col("event_type") == "view", F.col("event_id")), "seen")
    return e.groupBy("user_id", "block").agg(F.count("*").alias("lines"), F.coalesce(F.max("seen"), F.lit(-1)).alias("last_view"))


@_query(
    "q33_rotate_points",
    f"""WITH {_PTS} SELECT vec_id, round(100 + (x - 100) * cos(label / 10.0::DOUBLE) - (z - 200) * sin(label / 10.0::DOUBLE), 3) AS rx, round(200 + (x - 100) * sin(label / 10.0::DOUBLE) + (z - 200) * cos(label / 10.0::DOUBLE), 3) AS rz,
        round(x + 4.5 * cos(label / 10.0::DOUBLE), 3) AS cx, round(sqrt(x * x + z * z), 3) AS hyp FROM pts""",
)
def q33(spark, d):
    x, z, a = F.col("x"), F.col("z"), F.col("label") / F.lit(10.0)
    rx, rz = geometry.rotate(x, z, a, F.lit(100.0), F.lit(200.0))
    out = {"rx": rx, "rz": rz, "cx": geometry.corner(x, z, F.lit(4.5), a)[0], "hyp": geometry.length(x, z)}
    return _points(spark, d).select("vec_id", *(F.round(c, 3).alias(k) for k, c in out.items()))


@_query(
    "q34_road_hermite",
    f"""{_NEXT}, t AS (SELECT *, unnest(range(0, 8)) AS i FROM s), u AS (SELECT *, i / 7.0::DOUBLE AS q FROM t)
        SELECT vec_id, i::BIGINT AS i, round((2*q*q*q - 3*q*q + 1) * x + (3*q*q - 2*q*q*q) * nx + (q*q*q - 2*q*q + q) * 50 + (q*q*q - q*q) * 50, 3) AS px,
               round((2*q*q*q - 3*q*q + 1) * z + (3*q*q - 2*q*q*q) * nz + (q*q*q - 2*q*q + q) * -25 + (q*q*q - q*q) * 25, 3) AS pz FROM u""",
)
def q34(spark, d):
    at = _segments(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    q = F.col("i") / F.lit(7.0)
    px = geometry.hermite(q, F.col("x"), F.col("next_x"), F.lit(50.0), F.lit(50.0))
    pz = geometry.hermite(q, F.col("z"), F.col("next_z"), F.lit(-25.0), F.lit(25.0))
    return at.select("vec_id", "i", F.round(px, 3).alias("px"), F.round(pz, 3).alias("pz"))


@_query(
    "q35_node_rotation",
    f"WITH {_PTS} SELECT vec_id, round(((pi() - atan2(z, x)) % pi()) * 2, 5) AS rotation, round(atan2(z, x), 5) AS yaw, round(label - pi() - atan2(z, x) + pi() / 2, 5) AS placed FROM pts",
)
def q35(spark, d):
    x, z = F.col("x"), F.col("z")
    return _points(spark, d).select("vec_id", F.round(geometry.node_rotation(x, z), 5).alias("rotation"), F.round(F.atan2(z, x), 5).alias("yaw"), F.round(geometry.placement_angle(F.col("label"), x, z), 5).alias("placed"))


@_query(
    "q36_zoom_index_scale",
    f"""WITH {_PTS} SELECT vec_id, (CASE WHEN least(abs(x) * 10, abs(z) * 10) < 1000 THEN 0 WHEN least(abs(x) * 10, abs(z) * 10) < 5000 THEN 1 WHEN least(abs(x) * 10, abs(z) * 10) < 18500 THEN 2 ELSE 3 END)::BIGINT AS zoom,
        round(256.0::DOUBLE / (2000 + abs(x)), 6) AS scale, round(x + coalesce([-10, 4, 7][label + 1], 0) / 2.0::DOUBLE, 3) AS label_x FROM pts""",
)
def q36(spark, d):
    x, z = F.col("x"), F.col("z")
    offset = F.coalesce(F.get(F.array(*map(F.lit, (-10, 4, 7))), F.col("label").cast("int")), F.lit(0))
    return _points(spark, d).select("vec_id", geometry.zoom_index(F.abs(x) * 10, F.abs(z) * 10).cast("long").alias("zoom"), F.round(F.lit(256.0) / (2000 + F.abs(x)), 6).alias("scale"), F.round(x + offset / F.lit(2.0), 3).alias("label_x"))


@_query(
    "q37_fit_map",
    f"""WITH {_PTS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1, max(x) - min(x) + 1000.0::DOUBLE AS w, max(z) - min(z) + 1000.0::DOUBLE AS h FROM pts)
        SELECT round(CASE WHEN w > h THEN 512 / w ELSE 256 / h END, 8) AS scale, round(CASE WHEN w > h THEN x0 - 500 ELSE x0 - 500 + (w - 512 / (256 / h)) / 2 END, 3) AS x,
               round(CASE WHEN w > h THEN z0 - 500 + (h - 256 / (512 / w)) / 2 ELSE z0 - 500 END, 3) AS z FROM b""",
)
def q37(spark, d):
    b = spatial.bounds(_points(spark, d))
    scale, x, z = geometry.fit_map(F.col("min_x"), F.col("max_x"), F.col("min_z"), F.col("max_z"), 500.0, 512.0, 256.0)
    return b.select(F.round(scale, 8).alias("scale"), F.round(x, 3).alias("x"), F.round(z, 3).alias("z"))


@_query(
    "q38_unnest_spawns",
    """WITH u AS (SELECT vec_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings),
            s AS (SELECT *, CASE pos % 20 WHEN 3 THEN 'Fuel' WHEN 4 THEN 'Service' WHEN 6 THEN 'WeightStation' WHEN 7 THEN 'TruckDealer' WHEN 8 THEN 'Hotel' WHEN 15 THEN 'Garage' WHEN 16 THEN 'Recruitment' END AS label FROM u WHERE v > 0.15)
       SELECT label, count(*) AS n, count(DISTINCT vec_id) AS items FROM s WHERE label IS NOT NULL GROUP BY label""",
)
def q38(spark, d):
    u = _table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).where("v > 0.15")
    labelled = u.select("vec_id", exports.spawn_label(F.col("pos") % 20)["label"].alias("label")).where("label IS NOT NULL")
    return labelled.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("items"))


@_query(
    "q39_ferry_curve",
    f"""WITH {_PTS}, p AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, x, z, x / 1000 AS rot FROM pts QUALIFY i <= label % 4),
            f AS (SELECT DISTINCT label FROM pts), e AS (SELECT label, max(i) AS last FROM p GROUP BY label),
            n AS (SELECT label, 0 AS i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS z, coalesce(atan2(q.z, q.x), atan2(200, 300)) AS rot FROM f LEFT JOIN (SELECT label, x, z FROM p WHERE i = 1) q USING (label)
                  UNION ALL SELECT label, i, x, z, rot FROM p
                  UNION ALL SELECT f.label, 99, 300.0, 200.0, coalesce(atan2(200 - q.z, 300 - q.x), atan2(200, 300)) FROM f LEFT JOIN (SELECT p.label, x, z FROM p JOIN e ON p.label = e.label AND p.i = e.last) q USING (label)),
            s AS (SELECT n.*, lead(x) OVER w AS nx, lead(z) OVER w AS nz, lead(rot) OVER w AS nrot, row_number() OVER w - 1 AS seg, e.last IS NULL AS straight FROM n LEFT JOIN e USING (label) WINDOW w AS (PARTITION BY n.label ORDER BY i)),
            t AS (SELECT *, CASE WHEN straight THEN 0 ELSE sqrt((nx - x) * (nx - x) + (nz - z) * (nz - z)) / 3 END AS third FROM s WHERE nx IS NOT NULL)
        SELECT label, seg::BIGINT AS seg, round(x, 3) AS x0, round(x + cos(rot) * third, 3) AS c0x, round(z + sin(rot) * third, 3) AS c0z, round(nx - cos(nrot) * third, 3) AS c1x, round(nz - sin(nrot) * third, 3) AS c1z, round(nz, 3) AS z1 FROM t""",
)
def q39(spark, d):
    p = runs.positions(_points(spark, d), ["label"], ["vec_id"], 1, 3).where("pos <= label % 4")
    lists = p.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "z", (F.col("x") / 1000).alias("rot")))).alias("l"))
    ferries = _points(spark, d).select("label").distinct().join(lists, "label", "left")
    points = F.transform(F.coalesce("l", F.slice(F.array(F.struct(F.lit(0).cast("long").alias("pos"), *(F.lit(0.0).alias(c) for c in ("x", "z", "rot")))), 1, 0)), lambda q: F.struct(q["x"].alias("x"), q["z"].alias("z"), q["rot"].alias("rot")))
    port = lambda x, z: F.struct(F.lit(x).alias("x"), F.lit(z).alias("z"))
    curve = ferries.withColumn("points", points).select("label", F.posexplode(geometry.ferry_curve(port(0.0, 0.0), F.col("points"), port(300.0, 200.0))).alias("seg", "s"))
    return curve.select("label", F.col("seg").cast("long").alias("seg"), *(F.round(F.col(f"s.{c}"), 3).alias(c) for c in ("x0", "c0x", "c0z", "c1x", "c1z", "z1")))


def _file(path, *lines) -> list:
    """Columns of a text file: its path and its lines' bytes."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return [text(path).alias("path"), F.encode(F.concat_ws("\n", *map(text, lines)), "UTF-8").alias("content")]


def _including(rows: DataFrame, path: str, name) -> DataFrame:
    """A file that includes others, in the order of their names."""
    return rows.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('@include "'), name, F.lit('"')))), "\n").alias("t")).select(F.lit(path).alias("path"), F.encode("t", "UTF-8").alias("content"))


@_query(
    "q40_city_definitions",
    f"""SELECT {_TOKEN.format("('c' || n_nationkey)")} AS token, n_name AS name, 'loc' || (n_nationkey // 2) AS loc_token, 'r' || n_regionkey AS country, (n_nationkey + 5) || ',' || (n_nationkey + 6) || ',' || (n_nationkey + 8) AS x_offsets, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' EN' END AS en
        FROM nation""",
)
def q40(spark, d):
    n, key = _table(spark, d, "nation"), F.col("n_nationkey")
    offsets = [F.concat(F.lit("\tmap_x_offsets[]: "), (key + i).cast("string")) if i != 7 else F.lit("\tmap_x_offsets[]: none") for i in range(1, 9)]
    own = n.select(*_file(F.concat(F.lit("def/city/"), key, F.lit(".sui")), F.concat(F.lit("city_data : city.c"), key, F.lit(" {")), F.concat(F.lit('\tcity_name: "'), "n_name", F.lit('"')),
                          F.concat(F.lit('\tcity_name_localized: "@@loc'), F.floor(key / 2), F.lit('@@"')), F.concat(F.lit("\tcountry: r"), "n_regionkey", F.lit(" // its land")), "# city_name: wrong", *offsets, "}"))
    files = own.unionByName(_including(n, "def/city.sii", F.concat(F.lit("city/"), key, F.lit(".sui"))))
    names = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("loc"), F.floor(key / 2)).alias("key"), F.lit("en_us").alias("locale"), F.concat("n_name", F.lit(" EN")).alias("name"))
    out = definitions.with_names(definitions.cities(files), names)
    en = F.when(F.try_element_at("localized_names", F.lit("en_us")) == F.concat("name", F.lit(" EN")), F.concat("name", F.lit(" EN")))
    return out.select("token", "name", "loc_token", "country", F.array_join(F.transform("x_offsets", lambda x: x.cast("string")), ",").alias("x_offsets"), en.alias("en"))


@_query(
    "q41_country_definitions",
    f"SELECT {_TOKEN.format("('r' || r_regionkey)")} AS token, r_regionkey AS country_id, r_name AS name, 'loc_r' || r_regionkey AS loc_token, upper(left(r_name, 2)) AS country_code, (r_regionkey * 1.5)::DOUBLE AS x, (r_regionkey * 2.25 - 10)::DOUBLE AS y FROM region",
)
def q41(spark, d):
    r, key = _table(spark, d, "region"), F.col("r_regionkey")
    pos = F.concat(F.lit("pos: ("), (key * 1.5).cast("string"), F.lit(", 7, "), (key * 2.25 - 10).cast("string"), F.lit(")"))
    own = r.select(*_file(F.concat(F.lit("def/country/"), key, F.lit(".sui")), F.concat(F.lit("country_data : country.data.r"), key), "{", F.concat(F.lit("country_id: "), key), F.concat(F.lit('name: "'), "r_name", F.lit('"')),
                          F.concat(F.lit('name_localized: "@@loc_r'), key, F.lit('@@"')), F.concat(F.lit('country_code: "'), F.upper(F.left("r_name", F.lit(2))), F.lit('"')), pos, "}"))
    files = own.unionByName(_including(r, "def/country.sii", F.concat(F.lit("country/"), key, F.lit(".sui"))))
    wide = lambda c: F.col(c).cast("double").alias(c)
    return definitions.countries(files).select("token", "country_id", "name", "loc_token", "country_code", wide("x"), wide("y"))


@_query(
    "q42_road_looks",
    f"""SELECT {_TOKEN.format("('look' || s_suppkey)")} AS token, (s_suppkey % 7 * 0.5)::DOUBLE AS "offset", s_suppkey % 4 AS lanes_left, (s_suppkey % 7 * 0.5 + 4.5 * (s_suppkey % 4) + 4.5 * (s_suppkey % 3))::DOUBLE AS width FROM supplier""",
)
def q42(spark, d):
    s, key = _table(spark, d, "supplier"), F.col("s_suppkey")
    lanes = lambda side, n: F.array_join(F.array_repeat(F.lit(f"\tlanes_{side}[]: traffic_lane.road"), n.cast("int")), "\n")
    files = s.select(*_file(F.concat(F.lit("def/world/road_look."), key, F.lit(".sii")), "SiiNunit", F.concat(F.lit("road_look : road.look"), key, F.lit(" {")), lanes("left", key % 4), lanes("right", key % 3), F.concat(F.lit("\troad_offset: "), (key % 7 * 0.5).cast("string")), "}"))
    left, right = F.col("lanes_left"), F.col("lanes_right")
    out = definitions.road_looks(files)
    return out.select("token", F.col("offset").cast("double").alias("offset"), F.size(left).cast("long").alias("lanes_left"), geometry.road_width(F.col("offset").cast("double"), left, right).alias("width"))


@_query(
    "q43_ferry_definitions",
    f"""WITH f AS (SELECT s_suppkey, s_suppkey % 9 AS a, s_suppkey % 5 AS b, printf('%08d', s_suppkey) AS seq FROM supplier),
             g AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY seq) AS r FROM f)
        SELECT {_TOKEN.format("('port' || a)")} AS start_token, {_TOKEN.format("('port' || b)")} AS end_token, round(s_suppkey / 256.0::DOUBLE, 5) AS x1, round(atan2(s_suppkey, 1), 5) AS rot0, 2 AS n FROM g WHERE r = 1""",
)
def q43(spark, d):
    s, key = _table(spark, d, "supplier"), F.col("s_suppkey")
    line = lambda kind, i, x, z: F.concat(F.lit(f"\tconnection_{kind}[{i}]: ("), x.cast("string"), F.lit(", 0, "), z.cast("string"), F.lit(")"))
    files = s.select(*_file(F.concat(F.lit("def/ferry/connection/"), F.lpad(key.cast("string"), 8, "0"), F.lit(".sii")), F.concat(F.lit("ferry_connection : conn.port"), key % 9, F.lit(".port"), key % 5, F.lit(" {")),
                            line("positions", 0, key * 2, key), line("positions", 1, key, key), line("directions", 0, F.lit(1), key), "}"))
    out = definitions.ferry_connections(files)
    return out.select("start_token", "end_token", F.round(F.element_at("points", 2)["x"].cast("double"), 5).alias("x1"), F.round(F.element_at("points", 1)["rot"], 5).alias("rot0"), F.size("points").alias("n"))


def _areas(spark, d) -> DataFrame:
    name = F.concat(F.lit("S"), "s_suppkey")
    names = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("en_us"), F.concat(name, F.lit(" EN"))))
    return _rects(spark, d).select(F.col("s_suppkey").alias("city_id"), "seq", "rx", "rz", "w", "h", name.alias("name"), names.alias("localized_names"), F.concat(F.lit("s"), "s_suppkey").alias("in_game_id"), F.lit("land").alias("country"))


def _items(spark, d) -> DataFrame:
    """Points as map items: overlays, ferries, parking triggers and bus stops by turns."""
    kinds = F.array(*map(F.lit, (exports.OVERLAY, exports.FERRY, exports.TRIGGER, exports.BUS_STOP)))
    p, key = _points(spark, d), F.col("vec_id")
    return p.select(
        key.alias("load_seq"), key.alias("uid"), F.get(kinds, F.pmod(key, F.lit(4)).cast("int")).alias("type"), "x", "z", (F.col("label") == 3).alias("hidden"), tokens.token(F.concat(F.lit("o"), F.col("label"))).alias("look_token"),
        F.lit(None).cast("array<long>").alias("nodes"), F.lit(0).alias("origin"), F.lit(None).cast("long").alias("prefab_uid"), (F.col("label") % 2 == 0).alias("is_train"), F.col("label").cast("int").alias("zoom_visibility"),
        F.array(F.lit(5).cast("long"), F.when(F.col("label") < 5, F.lit(tokens.token_of(exports.PARKING_ACTION))).otherwise(F.lit(6).cast("long"))).alias("actions"),
    )


_ITEMS = f"{_PTS}, {_RECTS}, c AS (SELECT vec_id, arg_min(s_suppkey, seq) AS city FROM pts JOIN rects ON x >= rx AND x <= rx + w AND z >= rz AND z <= rz + h GROUP BY vec_id), i AS (SELECT pts.*, CASE WHEN city IS NULL THEN NULL WHEN city % 2 = 0 THEN 'S' || city || ' EN' ELSE 'S' || city END AS city FROM pts LEFT JOIN c USING (vec_id))"


@_query("q44_bus_stops", f"""WITH {_ITEMS} SELECT round(x, 3) AS "X", round(z, 3) AS "Y", 'BusStop' AS "Type", coalesce(city, 'none') AS "City" FROM i WHERE vec_id % 4 = 3""")
def q44(spark, d):
    out = exports.bus_stops(_items(spark, d), _areas(spark, d))
    return out.select(F.round("X", 3).alias("X"), F.round("Y", 3).alias("Y"), "Type", F.coalesce("City.Name", F.lit("none")).alias("City"))


@_query(
    "q45_overlay_sources",
    f"""WITH {_ITEMS}, o AS (SELECT *, CASE vec_id % 4 WHEN 0 THEN 'o' || label WHEN 1 THEN CASE WHEN label % 2 = 0 THEN 'train_ico' ELSE 'port_overlay' END ELSE 'parking_ico' END AS name,
              CASE vec_id % 4 WHEN 0 THEN 'Overlay' WHEN 1 THEN CASE WHEN label % 2 = 0 THEN 'Train' ELSE 'Ferry' END ELSE 'Parking' END AS type FROM i WHERE label <> 3 AND (vec_id % 4 < 2 OR vec_id % 4 = 2 AND label < 5))
        SELECT round(x, 3) AS "X", round(z, 3) AS "Y", CASE WHEN type = 'Overlay' THEN label ELSE -1 END AS "ZoomLevelVisibility", name AS "Name", type AS "Type", 16 + length(name) AS "Width", coalesce(city, 'none') AS "City"
        FROM o WHERE name NOT IN ('o1', 'o2')""",
)
def q45(spark, d):
    names = F.array(*map(F.lit, ("parking_ico", "train_ico", "port_overlay", "o0", *(f"o{k}" for k in range(3, 10)))))
    bitmaps = spark.range(1).select(F.explode(names).alias("name")).select(tokens.token(F.col("name")).alias("token"), "name", (F.length("name") + 16).alias("width"), F.lit(8).alias("height"))
    none = lambda schema: spark.createDataFrame([], schema)
    out = exports.overlay_rows(_items(spark, d), none("token long, path string"), none(PREFABS), none(NODES), _areas(spark, d), bitmaps)
    return out.select(F.round("X", 3).alias("X"), F.round("Y", 3).alias("Y"), F.coalesce(F.col("ZoomLevelVisibility").cast("long"), F.lit(-1)).alias("ZoomLevelVisibility"), "Name", "Type", F.col("Width").cast("long").alias("Width"), F.coalesce("City.Name", F.lit("none")).alias("City"))


@_query(
    "q46_road_points",
    f"""WITH {_PTS}, r AS (SELECT o_orderkey, a.x AS x0, a.z AS z0, a.label AS r0, b.x AS x1, b.z AS z1, b.label AS r1, sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) AS c FROM orders JOIN pts a ON o_orderkey % 500 = a.vec_id JOIN pts b ON o_custkey % 700 = b.vec_id),
             t AS (SELECT *, unnest(range(0, 8)) AS pos FROM r), u AS (SELECT *, pos / 7.0::DOUBLE AS q FROM t)
        SELECT o_orderkey AS load_seq, pos::INT AS pos, round((2*q*q*q - 3*q*q + 1) * x0 + (3*q*q - 2*q*q*q) * x1 + (q*q*q - 2*q*q + q) * cos(r0 - pi() / 2) * c + (q*q*q - q*q) * cos(r1 - pi() / 2) * c, 3) AS x,
               round((2*q*q*q - 3*q*q + 1) * z0 + (3*q*q - 2*q*q*q) * z1 + (q*q*q - 2*q*q + q) * sin(r0 - pi() / 2) * c + (q*q*q - q*q) * sin(r1 - pi() / 2) * c, 3) AS y FROM u""",
)
def q46(spark, d):
    nodes = _points(spark, d).select(F.col("vec_id").alias("uid"), "x", "z", F.col("label").cast("double").alias("rotation"))
    roads = _table(spark, d, "orders").select(F.col("o_orderkey").alias("load_seq"), F.lit(exports.ROAD).alias("type"), (F.col("o_orderkey") % 500).alias("start_uid"), (F.col("o_custkey") % 700).alias("end_uid"))
    return exports.road_points(roads, nodes).select("load_seq", "pos", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@_query(
    "q47_tile_features",
    f"""WITH {_PTS}, t AS (SELECT z AS zoom, i AS tx, j AS ty, 8000.0::DOUBLE / (1 << z) AS step FROM (SELECT unnest(range(0, 3)) AS z), (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j) WHERE i < (1 << z) AND j < (1 << z))
        SELECT zoom::INT AS zoom, tx, ty, vec_id, label FROM t JOIN pts ON x >= -4000 + tx * step - step / 8 AND x <= -4000 + (tx + 1) * step + step / 8 AND pts.z >= -4000 + ty * step - step / 8 AND pts.z <= -4000 + (ty + 1) * step + step / 8""",
)
def q47(spark, d):
    return spatial.tile_features(_points(spark, d), range(3), -4000.0, 8000.0, 0.125).select("zoom", "tx", "ty", "vec_id", "label")


@_query(
    "q48_label_position",
    f"""WITH {_PTS} SELECT s_suppkey, round(coalesce(x, s_suppkey) + CASE WHEN s_suppkey % 4 > 1 THEN 30 / (0.5::DOUBLE * 5000) ELSE 0 END, 6) AS x, round(coalesce(z, -s_suppkey) + CASE WHEN s_suppkey % 4 > 1 THEN -20 / (0.5::DOUBLE * 5000) ELSE 0 END, 6) AS z
        FROM supplier LEFT JOIN pts ON s_suppkey * 3 = vec_id""",
)
def q48(spark, d):
    nodes = _points(spark, d).select(F.col("vec_id").alias("uid"), "x", "z")
    cities = _table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 3).alias("node_uid"), F.col("s_suppkey").cast("double").alias("px"), (-F.col("s_suppkey")).cast("double").alias("pz"))
    count = (F.col("s_suppkey") % 4).cast("int")
    offsets = lambda *n: F.slice(F.array(*map(F.lit, n)), F.lit(1), count)
    x, z = geometry.label_position(F.col("node"), F.col("px"), F.col("pz"), offsets(10, 30, 50), offsets(-10, -20, -30), 1, 0.5)
    return lookup.with_node(cities, nodes, "node_uid").select("s_suppkey", F.round(x, 6).alias("x"), F.round(z, 6).alias("z"))


@_query(
    "q49_ports_and_connections",
    "SELECT s_suppkey, n_nationkey AS end_token, printf('#%02X%02X%02X', s_suppkey % 256, n_nationkey * 10, 255) AS colour FROM supplier JOIN nation ON s_nationkey % 5 = n_regionkey",
)
def q49(spark, d):
    ports = _table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("port_token"))
    ferries = _table(spark, d, "nation").select(F.col("n_regionkey").alias("start_token"), F.col("n_nationkey").alias("end_token"))
    colour = strings.rgb_hex(F.col("s_suppkey") % 256, F.col("end_token") * 10, F.lit(255))
    return lookup.connections_from(ports, ferries).select("s_suppkey", "end_token", colour.alias("colour"))


@_query(
    "q50_overlay_chain",
    "SELECT 'icon' || p_partkey AS name, 'tex/' || p_size || '.dds' AS texture FROM part WHERE p_partkey % 3 <> 0",
)
def q50(spark, d):
    p, key = _table(spark, d, "part"), F.col("p_partkey")
    folder = F.when(key % 3 == 1, "material/ui/company/small/icon").otherwise("material/ui/map/road/road_icon")
    materials = p.where("p_partkey % 3 <> 0").select(*_file(F.concat(folder, key, F.lit(".mat")), "effect : ui", F.concat(F.lit('\ttexture : "'), F.lit("/ptr/"), key, F.lit('.tobj"'))))
    skipped = p.where("p_partkey % 3 = 0").select(*_file(F.concat(F.lit("material/ui/map/map_icon"), key, F.lit(".mat")), 'texture : "/ptr/1.tobj"'))
    pointers = p.select(F.concat(F.lit("ptr/"), key, F.lit(".tobj")).alias("path"), F.concat(F.unhex(F.lit("00" * 48)), F.encode(F.concat(F.lit("/tex/"), "p_size", F.lit(".dds")), "UTF-8")).alias("content"))
    return tables.overlay_catalogue(materials.unionByName(skipped).unionByName(pointers)).select("name", "texture")


@_query(
    "q51_property_lines",
    r"""WITH l AS (SELECT event_type, unnest(string_split(coalesce(props, ''), ',')) AS line FROM events), t AS (SELECT event_type, regexp_replace(line, '^[^!-~]+|[^!-~]+$', '', 'g') AS line FROM l),
             v AS (SELECT event_type, regexp_replace(split_part(line, ':', 1), '^[^!-~]+|[^!-~]+$', '', 'g') AS k, regexp_replace(split_part(line, ':', 2), '^[^!-~]+|[^!-~]+$', '', 'g') AS v FROM t WHERE contains(line, ':') AND NOT starts_with(line, '#') AND NOT starts_with(line, '//'))
        SELECT event_type, coalesce(split_part(k, '"', 2), '') AS key, count(*) AS lines, sum(length(k) + length(v))::BIGINT AS chars, count(DISTINCT v) AS vals FROM v GROUP BY 1, 2""",
)
def q51(spark, d):
    lines = _table(spark, d, "events").select("event_type", F.explode(F.split(F.coalesce("props", F.lit("")), ",")).alias("line"))
    keyed = lines.where(~strings.is_comment(F.col("line"))).select("event_type", strings.line_key(F.col("line")).alias("k"), strings.line_value(F.col("line")).alias("v")).where("k IS NOT NULL")
    key = F.coalesce(strings.quoted(F.col("k")), F.lit("")).alias("key")
    return keyed.groupBy("event_type", key).agg(F.count("*").alias("lines"), F.sum(F.length("k") + F.length("v")).alias("chars"), F.countDistinct("v").alias("vals"))
