"""Queries on trees of files and tiles and on archives as files, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolyte.operators import lookup, pyramid
from cartolyte.plans import binaries
from cartolyte.plans.catalogue import _PTS, _RECTS, _points, _rects, _table, query_into
from cartolyte.sources import archives, sinks, trees
from cartolyte.sources.shared import new_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_query = query_into(QUERIES, ORACLE_SQL)


def _text_file(df: DataFrame, path, *lines) -> DataFrame:
    """Text files from columns, lines that are null left out."""
    return df.select(path.alias("path"), F.encode(F.concat_ws("\n", *lines), "UTF-8").alias("content"))


def _includes(df: DataFrame, key: str, letter: str, by: list[str]) -> DataFrame:
    """The include lines of files, for each group in the order of their numbers."""
    line = F.concat(F.lit(f'@include "{letter}'), key, F.lit('.sui"'))
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(key), line.alias("line")))).alias("l")).select(*by, F.array_join("l.line", "\n").alias("lines"))


@_query(
    "q69_nested_includes",
    r"""WITH RECURSIVE f AS (
          SELECT 'def/world.sii' AS path, 'SiiNunit' || chr(10) || string_agg('@include "r' || r_regionkey || '.sui"', chr(10) ORDER BY r_regionkey) || chr(10) || '}' AS text FROM region
          UNION ALL SELECT 'def/r' || r_regionkey || '.sui', 'region : ' || r_regionkey || chr(10) || string_agg('@include "n' || n_nationkey || '.sui"', chr(10) ORDER BY n_nationkey) || chr(10) || CASE r_regionkey WHEN 1 THEN '@include "world.sii"' WHEN 2 THEN '@include "none.sui"' ELSE '}' END
                    FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey
          UNION ALL SELECT 'def/n' || n_nationkey || '.sui', 'nation : ' || n_name || CASE WHEN n_nationkey % 5 = 0 THEN chr(10) || '@include "r' || n_regionkey || '.sui"' WHEN n_nationkey % 5 = 1 THEN chr(10) || '@include "n' || (n_nationkey + 1) || '.sui"' ELSE '' END FROM nation),
        l AS (SELECT path, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM (SELECT path, string_split(text, chr(10)) AS x FROM f)),
        e AS (SELECT path, line_no, 'def/' || split_part(line, '"', 2) AS target FROM l WHERE starts_with(line, '@include') AND 'def/' || split_part(line, '"', 2) IN (SELECT path FROM f)),
        t AS (SELECT path, path AS source, ''::VARCHAR AS at, [path] AS trail FROM f WHERE path = 'def/world.sii'
              UNION ALL SELECT t.path, e.target, t.at || e.line_no || '/', list_append(t.trail, e.target) FROM t JOIN e ON t.source = e.path WHERE NOT list_contains(t.trail, e.target))
        SELECT t.path, t.at || l.line_no AS at, t.source, l.line FROM t JOIN l ON t.source = l.path WHERE (l.path, l.line_no) NOT IN (SELECT (path, line_no) FROM e)""",
)
def q69(spark: SparkSession, d: str) -> DataFrame:
    """Three and more levels of includes, with files that include those that include them."""
    region, nation = _table(spark, d, "region"), _table(spark, d, "nation")
    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    world = _text_file(_includes(region, "r_regionkey", "r", []), F.lit("def/world.sii"), F.lit("SiiNunit"), F.col("lines"), F.lit("}"))
    own = region.join(_includes(nation, "n_nationkey", "n", ["n_regionkey"]), r == F.col("n_regionkey"))
    last = F.when(r == 1, '@include "world.sii"').when(r == 2, '@include "none.sui"').otherwise("}")
    regions = _text_file(own, F.concat(F.lit("def/r"), r, F.lit(".sui")), F.concat(F.lit("region : "), r), F.col("lines"), last)
    more = F.when(n % 5 == 0, F.concat(F.lit('@include "r'), F.col("n_regionkey"), F.lit('.sui"'))).when(n % 5 == 1, F.concat(F.lit('@include "n'), n + 1, F.lit('.sui"')))
    nations = _text_file(nation, F.concat(F.lit("def/n"), n, F.lit(".sui")), F.concat(F.lit("nation : "), "n_name"), more)
    out = trees.expand_nested(world.unionByName(regions).unionByName(nations), F.col("path") == "def/world.sii")
    return out.select("path", F.array_join(F.transform("at", lambda i: i.cast("string")), "/").alias("at"), "source", "line")


@_query(
    "q70_folder_listing",
    """WITH p AS (SELECT 'b' || p_size % 5 AS a, 'b' || p_size % 5 || '/t' || p_size AS b, 'b' || p_size % 5 || '/t' || p_size || '/p' || p_partkey || '.sii' AS c FROM part)
       SELECT DISTINCT a AS path, 1 AS depth, true AS is_folder FROM p UNION ALL SELECT DISTINCT b, 2, true FROM p UNION ALL SELECT c, 3, false FROM p""",
)
def q70(spark: SparkSession, d: str) -> DataFrame:
    """All folders and files below the root, from the lines of each folder's listing."""
    p = _table(spark, d, "part").select(F.concat(F.lit("b"), F.col("p_size") % 5).alias("a"), F.concat(F.lit("t"), "p_size").alias("b"), F.concat(F.lit("p"), "p_partkey", F.lit(".sii")).alias("c"))
    inner = F.concat("a", F.lit("/"), "b")
    row = lambda folder, line: F.struct(folder.alias("folder"), line.alias("line"))
    star = lambda c: F.concat(F.lit("*"), c)
    rows = F.array(row(F.lit(""), star("a")), row(F.col("a"), star("b")), row(F.col("a"), F.lit("*")), row(inner, F.col("c")))
    return trees.listed(p.select(F.explode(rows).alias("r")).select("r.*").distinct())


@_query(
    "q71_tile_pyramid",
    f"""WITH {_PTS}, {_RECTS}, t AS (SELECT z AS zoom, i AS tx, j AS ty, -4000 + i * 8000.0::DOUBLE / (1 << z) AS bx, -4000 + j * 8000.0::DOUBLE / (1 << z) AS bz, 8000.0::DOUBLE / (1 << z) AS step FROM (SELECT unnest(range(0, 5)) AS z), (SELECT unnest(range(0, 16)) AS i), (SELECT unnest(range(0, 16)) AS j) WHERE i < (1 << z) AND j < (1 << z)),
             r AS (SELECT o_orderkey AS id, a.x AS x0, a.z AS z0, b.x - a.x AS dx, b.z - a.z AS dz FROM orders JOIN pts a ON o_orderkey % 500 = a.vec_id JOIN pts b ON o_custkey % 700 = b.vec_id),
             c AS (SELECT zoom, tx, ty, id, CASE WHEN dx = 0 THEN CASE WHEN x0 BETWEEN bx - 100 AND bx + step + 100 THEN [0, 1] END ELSE [least((bx - 100 - x0) / dx, (bx + step + 100 - x0) / dx), greatest((bx - 100 - x0) / dx, (bx + step + 100 - x0) / dx)] END AS u,
                          CASE WHEN dz = 0 THEN CASE WHEN z0 BETWEEN bz - 100 AND bz + step + 100 THEN [0, 1] END ELSE [least((bz - 100 - z0) / dz, (bz + step + 100 - z0) / dz), greatest((bz - 100 - z0) / dz, (bz + step + 100 - z0) / dz)] END AS v FROM r, t),
             m AS (SELECT zoom, tx, ty, id, false AS area FROM c WHERE greatest(u[1], v[1], 0) <= least(u[2], v[2], 1) AND u IS NOT NULL AND v IS NOT NULL
                   UNION ALL SELECT zoom, tx, ty, s_suppkey, true FROM rects JOIN t ON rx - 100 < bx + step AND rx + w + 100 >= bx AND rz - 100 < bz + step AND rz + h + 100 >= bz)
        SELECT zoom::INT AS zoom, tx, ty, area, count(*) AS n, sum(id)::BIGINT AS ids FROM m GROUP BY ALL""",
)
def q71(spark: SparkSession, d: str) -> DataFrame:
    """Which straight roads and which areas each tile of five zooms has to show."""
    nodes = _points(spark, d).withColumnRenamed("vec_id", "uid")
    roads = _table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 500).alias("a"), (F.col("o_custkey") % 700).alias("b"))
    at = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    lines = lookup.with_ends(roads, nodes, "a", "b").select(F.col("o_orderkey").alias("id"), F.lit(False).alias("closed"), F.array(*(at(F.col(f"{e}.x"), F.col(f"{e}.z")) for e in ("start", "end"))).alias("points"))
    x0, z0, x1, z1 = F.col("rx"), F.col("rz"), F.col("rx") + F.col("w"), F.col("rz") + F.col("h")
    areas = _rects(spark, d).select((-1 - F.col("s_suppkey")).alias("id"), F.lit(True).alias("closed"), F.array(at(x0, z0), at(x1, z0), at(x1, z1), at(x0, z1)).alias("points"))
    rows = pyramid.write_pyramid(lines.unionByName(areas), range(5), -4000.0, 8000.0, 100.0, new_path(spark, "pyramid"))
    area, number = F.col("id") < 0, F.when(F.col("id") < 0, -1 - F.col("id")).otherwise(F.col("id"))
    counts = rows.groupBy("zoom", "key", area.alias("area")).agg(F.count("*").alias("n"), F.sum(number).alias("ids"))
    tx, ty = pyramid.tile_of(F.col("key"))
    return counts.select("zoom", tx.alias("tx"), ty.alias("ty"), "area", "n", "ids")


@_query(
    "q72_archive_scan",
    """WITH f AS (SELECT 'only/' || s_nationkey || '.sii' AS path, CASE WHEN s_suppkey % 7 = 0 THEN 2 ELSE 0 END AS archive_seq, 'z' || s_suppkey || '.scs' AS archive, 'of ' || s_suppkey AS text FROM supplier WHERE s_nationkey < 20)
       SELECT path, archive_seq::INT AS archive_seq, text FROM f QUALIFY row_number() OVER (PARTITION BY path ORDER BY archive_seq DESC, archive DESC) = 1""",
)
def q72(spark: SparkSession, d: str) -> DataFrame:
    """Archives written as files of the shared folder, one for each supplier, then planned by their indices and read by ranges: the winner of each path that the condition lets through."""
    s, folder = binaries._rows(spark, d, "supplier", "s_suppkey"), new_path(spark, "archives")
    path = F.concat(F.lit("only/"), "s_nationkey", F.lit(".sii"))
    zipped = binaries.zip_archive(path, F.concat(F.lit("of "), "s_suppkey"))
    sinks.write_files(s.select(F.concat(F.lit("z"), "s_suppkey", F.lit(".scs")).alias("name"), F.unhex(zipped).alias("content")), folder)
    upper = {f"z{r['s_suppkey']}.scs": 2 for r in s.where("s_suppkey % 7 = 0").select("s_suppkey").toLocalIterator()}
    wanted = [f"only/{k}.sii" for k in range(20)]
    found = archives.layered_archives(spark, folder, upper, lambda p: p.isin(*wanted))
    return found.select("path", "archive_seq", F.decode("content", "UTF-8").alias("text"))
