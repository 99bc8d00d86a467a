"""Clustered layouts, grids of several levels, scans in segments and total orders."""

import math
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cartolyte.operators import layout, runs, scans, spatial
from cartolyte.plans import exports, frame, ordered
from cartolyte.schemas import ITEMS, NODES, PREFABS


def scan_rows(df) -> int:
    """Rows that the plan's file scan gave out, once it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while not plan.nodeName().startswith("Scan"):
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def test_a_viewport_reads_few_row_groups(spark, tmp_path):
    points = spark.range(200_000).select(F.col("id"), (F.rand(1) * 10_000).alias("x"), (F.rand(2) * 10_000).alias("z")).cache()
    square, path = layout.Square(0.0, 0.0, 10_000.0), str(tmp_path / "points")
    layout.write_clustered(points, path, square, 64 << 10)
    seen = layout.viewport(spark.read.parquet(path), square, 2000, 3000, 2500, 3300, 100)
    want = points.where(spatial.in_viewport(F.col("x"), F.col("z"), 2000, 3000, 2500, 3300, 100))
    assert sorted(r["id"] for r in seen.collect()) == sorted(r["id"] for r in want.collect()) and want.count() > 100
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    seen = layout.viewport(spark.read.parquet(path), square, 2000, 3000, 2500, 3300, 100)
    pushed = seen._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1]
    assert "GreaterThanOrEqual(morton" in pushed and "LessThanOrEqual(morton" in pushed and "Or(" in pushed
    ranges = layout.key_ranges(1900, 2900, 2600, 3400, square)
    groups = []
    for file in sorted((tmp_path / "points").glob("part-*")):
        meta = pq.read_metadata(file)
        column = meta.schema.names.index(layout.KEY)
        for i in range(meta.num_row_groups):
            stats = meta.row_group(i).column(column).statistics
            groups.append((any(a <= stats.max and b >= stats.min for a, b in ranges), meta.row_group(i).num_rows))
    hit = [n for found, n in groups if found]
    assert 0 < len(hit) < len(groups) / 3 and scan_rows(seen) <= sum(hit) < 200_000 / 3


def test_ranges_hold_the_rectangle(spark):
    rng = random.Random(1)
    square = layout.Square(-50.0, 20.0, 100.0, 8)
    points = [(rng.uniform(-80, 80), rng.uniform(-10, 150)) for _ in range(2000)] + [(-50.0, 20.0), (50.0, 120.0), (math.inf, -math.inf)]
    keyed = [tuple(r) for r in spark.createDataFrame(points, "x double, z double").select("x", "z", layout.morton(F.col("x"), F.col("z"), square)).collect()]
    assert all(0 <= k < 1 << 16 for _, _, k in keyed)
    for _ in range(200):
        x0, x1 = sorted(rng.uniform(-90, 90) for _ in range(2))
        z0, z1 = sorted(rng.uniform(-20, 160) for _ in range(2))
        ranges = layout.key_ranges(x0, z0, x1, z1, square, 6)
        assert len(ranges) <= 6 and all(a <= b for a, b in ranges) and ranges == sorted(ranges)
        assert all(any(a <= k <= b for a, b in ranges) for x, z, k in keyed if x0 <= x <= x1 and z0 <= z <= z1)
    assert layout.key_ranges(-50, 20, 50, 120, square) == [(0, (1 << 16) - 1)]
    assert spark.createDataFrame([(None, 1.0)], "x double, z double").select(layout.morton(F.col("x"), F.col("z"), square)).first()[0] is None


def test_square_of_points(spark):
    assert layout.square_of(spark.createDataFrame([(1.0, 5.0), (4.0, -5.0)], "x double, z double")) == layout.Square(1.0, -5.0, 10.0)
    assert layout.square_of(spark.createDataFrame([], "x double, z double")).side == 1.0


RECTS = [
    (1, 0.0, 0.0, 1e9, 1e9), (2, -5.0, -5.0, 10.0, 10.0), (3, 100.0, 100.0, 0.0, 0.0), (4, -1e308, -1e308, math.inf, math.inf), (5, 0.0, 0.0, -1.0, 5.0), (6, 0.0, 0.0, math.nan, 1.0),
    (7, None, 0.0, 1.0, 1.0), (8, 1e17, 0.0, 1.0, 1e12), (9, 3.0, 3.0, 5000.0, 0.5), (10, -700.0, -1.0, 600.0, 2.0),
]


def test_levels_bound_the_cells_of_a_rectangle(spark):
    rects = spark.createDataFrame([(k, k, *r) for k, *r in RECTS], "rect long, seq long, rx double, rz double, w double, h double")
    cells = {r["rect"]: r["n"] for r in spatial.rect_cells(rects, 600.0).groupBy("rect").agg(F.count("*").alias("n")).collect()}
    assert set(cells) >= {1, 2, 3, 4, 8, 9, 10} and not set(cells) & {5, 6} and max(cells.values()) <= 9
    points = [(0, 0.0, 0.0), (1, 1e9, 1e9), (2, 100.0, 100.0), (3, -6.0, 0.0), (4, -1e6, 3.0), (5, 4000.0, 3.25), (6, -650.0, 0.5), (7, None, 1.0), (8, -4.0, 4.0)]
    joined = spatial.grid_join(spark.createDataFrame(points, "point long, x double, z double"), rects.where("rect <> 4"), "point", "rect", "seq", 600.0)
    assert {r["point"]: r["rect"] for r in joined.collect()} == {0: 1, 1: 1, 2: 1, 3: None, 4: None, 5: 1, 6: 10, 7: None, 8: 2}
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    none = spatial.grid_join(spark.createDataFrame(points, "point long, x double, z double"), rects.where("false"), "point", "rect", "seq", 600.0)
    assert {r["rect"] for r in none.collect()} == {None} and none.count() == len(points)


def test_levels_equal_the_nested_join(spark):
    rng = random.Random(7)
    rects = [(i, i, rng.uniform(-1e4, 1e4), rng.uniform(-1e4, 1e4), 10 ** rng.uniform(0, 7), 10 ** rng.uniform(0, 5)) for i in range(80)]
    points = [(i, rng.uniform(-2e4, 2e4), rng.uniform(-2e4, 2e4)) for i in range(1500)]
    points, rects = spark.createDataFrame(points, "p long, x double, z double"), spark.createDataFrame(rects, "r long, seq long, rx double, rz double, w double, h double")
    pairs = lambda df: sorted((a["p"], a["r"]) for a in df.collect())
    assert pairs(spatial.grid_join(points, rects, "p", "r", "seq", 50.0)) == pairs(spatial.nested_join(points, rects, "p", "r", "seq"))


def test_rectangles_over_all_points_are_few_nodes(spark):
    n = spatial._STRIPES
    ranges = spark.createDataFrame([(a, b) for a in (-1, 0, 3, n // 2 - 1, n - 1) for b in (0, 3, 4, n // 2, n - 1, n) if a <= b], "a int, b int")
    for a, b, pieces in ranges.select("a", "b", spatial._pieces(F.col("a"), F.col("b")).alias("p")).collect():
        assert len(pieces) <= 2 * spatial._STRIPE_BITS + 2
        held = [s for node, _ in pieces for s in range(n) if any(node == (s + n) >> k for k in range(spatial._STRIPE_BITS + 1))]
        assert sorted(held) == list(range(max(a, 0), min(b, n - 1) + 1))
        assert {node - n for node, whole in pieces if not whole} == {a, b} - {-1, n}


def test_equal_rectangles_and_edges_on_points(spark):
    rng = random.Random(3)
    rects = [(i, (i * 7) % 400, float(rng.randint(-5, 5)), float(rng.randint(-5, 5)), float(rng.choice((0, 1, 3, 100))), float(rng.choice((0, 2, 50)))) for i in range(400)]
    points = [(i, float(rng.randint(-8, 8)), float(rng.randint(-8, 8)) + rng.choice((0, 0.5))) for i in range(300)] + [(300, math.nan, 1.0), (301, 1.0, None), (302, math.inf, 0.0)]
    points, rects = spark.createDataFrame(points, "p long, x double, z double"), spark.createDataFrame(rects, "r long, seq long, rx double, rz double, w double, h double")
    pairs = lambda df: sorted((a["p"], a["r"] is None, a["r"]) for a in df.collect())
    assert pairs(spatial.grid_join(points, rects, "p", "r", "seq", 2.0)) == pairs(spatial.nested_join(points, rects, "p", "r", "seq"))


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "m"]])
def test_segments_equal_windows(spark, keys):
    # Most rows have one key, some none.
    k = F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 9 == 0, F.col("id") % 3).otherwise(7)
    rows = spark.range(3000).select(F.col("id").alias("n"), k.alias("k"), F.lit("m").alias("m"), F.when(F.hash("id") % 5 == 0, None).otherwise(F.hash("id") % 3).alias("v"))
    rows = rows.withColumn("seq", F.hash(F.col("n") + 1).cast("long") * 4096 + F.col("n") % 4096).cache()
    closes, value = F.col("v") == 1, F.when(F.col("v") == 2, F.col("n"))
    own = keys or ["one"]
    flat = rows.withColumn("one", F.lit(1))
    sort = lambda df: sorted(map(repr, df.select(sorted(df.columns)).drop("one").collect()))
    assert sort(scans.run_starts(rows, keys, ["seq"], "v", 7)) == sort(runs.run_starts(flat, own, ["seq"], "v"))
    assert sort(scans.with_next(rows, keys, ["seq"], ["n", "v"], 7)) == sort(runs.with_next(flat, own, ["seq"], ["n", "v"]))
    assert sort(scans.with_block(rows, keys, ["seq"], closes, 7)) == sort(runs.with_block(flat, own, ["seq"], closes))
    assert sort(scans.carried(rows, keys, ["seq"], value, "last", 7)) == sort(runs.carried(flat, own, ["seq"], value, "last"))
    assert scans.scan(rows.where("false"), keys, ["seq"], before={"b": "n"}, blocks={"c": closes}).collect() == []


SPREAD = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}


def test_one_key_is_spread_over_all_tasks(spark):
    rows = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("seq"))
    out = scans.scan(rows, ["k"], ["seq"], blocks={"block": F.col("seq") % 10 == 0}, stretches=16)
    tasks = out.select("block", F.spark_partition_id().alias("task")).groupBy("task").agg(F.count("*").alias("n"), F.max("block").alias("most"))
    for name, value in SPREAD.items():
        spark.conf.set(name, value)
    try:
        got = tasks.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r["n"] for r in got) == 20_000 and len(got) >= 6 and max(r["n"] for r in got) < 10_000 and max(r["most"] for r in got) == 2000


def test_total_places(spark):
    rows = spark.range(5000).select(F.col("id"), (F.hash("id") % 7).alias("a"), F.lit("x").alias("place_name"))
    out = scans.total_places(rows, ["a", "id"], stretches=9)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(out.collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, 5001)) and [(r["a"], r["id"]) for r in got] == sorted((r["a"], r["id"]) for r in got)
    assert scans.total_places(rows.where("false"), ["a"]).collect() == []


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_items_and_areas_are_read_once(spark):
    """All consumers of the items, of the placed prefabs and of the areas take one persisted table each."""
    spark.catalog.clearCache()
    seen = {}

    def counted(df, name):
        seen[name] = spark.sparkContext.accumulator(0)

        def run(frames, n=seen[name]):
            for frame_ in frames:
                n.add(len(frame_))
                yield frame_

        return df.mapInPandas(run, df.schema)

    items, areas = ordered._items(spark, SF), ordered._areas(spark, SF)
    out = exports.overlay_rows(counted(items, "items"), ordered._prefab_tokens(spark, SF), ordered._prefabs(spark, SF), ordered._nodes(spark, SF), counted(areas, "areas"), ordered._bitmaps(spark))
    assert out.count() > 50 and out.where("Type = 'Company'").count() > 5
    assert {k: n.value for k, n in seen.items()} == {"items": items.count(), "areas": areas.count()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryRelation" in plan
    spark.catalog.clearCache()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_a_frame_has_its_layers_in_order(spark):
    tables = (ordered._items(spark, SF), ordered._nodes(spark, SF), ordered._prefab_tokens(spark, SF), ordered._prefabs(spark, SF), ordered._shapes(spark, SF), ordered._ferries(spark, SF), ordered._bitmaps(spark))
    rows = sorted(frame.drawn(*tables, (-2500, -2300, 2700, 2400), stretches=5).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1)) and len({r["layer"] for r in rows}) == 12
    keys = [(r["layer"], r["z"], r["load_seq"], r["kind"], r["part"]) for r in rows]
    assert keys == sorted(set(keys))
    few = frame.drawn(*tables, (-2500, -2300, 2700, 2400), bits=4 | 64, stretches=5)
    assert {r["layer"] for r in few.collect()} == {0, 4, 11}
    assert "Window" not in few._jdf.queryExecution().executedPlan().toString()
    # The prefabs in view are one table for their shapes and their icons.
    spark.catalog.clearCache()


def test_frame_of_nothing(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    out = frame.drawn(none(ITEMS), none(NODES), none("token long, path string"), none(PREFABS), none("path string, look_no int, z_index int"), none("start_token long, end_token long, load_seq long"), none("token long"), (0, 0, 1, 1))
    assert [(r["layer"], r["place"]) for r in out.collect()] == [(0, 1)]
    spark.catalog.clearCache()
