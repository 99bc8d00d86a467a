"""Ferry curves, map fitting and prefab polygons."""

import math

import pytest
from pyspark.sql import functions as F

from cartolyte.functions import geometry
from cartolyte.operators import polygons
from cartolyte.plans import exports
from cartolyte.schemas import PREFABS


def point(x, z, near, lanes=-1, **more):
    return {"x": float(x), "z": float(z), "neighbours": near, "lane_count": lanes, "lane_offset": 0, "hidden": False, "color_flags": 0, "control_node": -1} | more


def looks_of(spark, nodes, points):
    nodes = [{"x": 0.0, "z": 0.0, "rot_x": 1.0, "rot_z": 0.0} | n for n in nodes]
    rows = polygons.shapes(spark.createDataFrame([("p", True, nodes, [], points, [])], PREFABS)).orderBy("look_no").collect()
    return [(r["z_index"], r["color"], [tuple(p) for p in r["points"]]) for r in rows]


def test_walk_and_areas(spark):
    square = [point(0, 0, [1, 3], color_flags=4), point(1, 0, [2, 0], color_flags=5), point(1, 1, [3, 1]), point(0, 1, [0, 2])]
    looks = looks_of(spark, [], square)
    assert len(looks) == 4 and looks[0] == (3, "dark", [(1, 0), (1, 1), (0, 1), (0, 0)])
    assert looks_of(spark, [], [point(0, 0, [1]), point(1, 0, [])]) == []


def test_roads_take_missing_lane_counts_from_the_other_end(spark):
    nodes = [{"lane_count": 3}]
    road = [point(0, 0, [1], -2, control_node=0), point(10, 0, [0, 2], -2), point(20, 0, [1], -2)]
    looks = looks_of(spark, nodes, road)
    assert [z for z, _, _ in looks] == [4, 4]
    assert looks[0][2][0] == pytest.approx((0, 6.75)) and looks[0][2][1] == pytest.approx((10, 6.75))
    assert looks[1][2][0] == pytest.approx((10, 2.25))


def test_placing(spark):
    prefab = [("p", [(1.0, 0.0, 1.0, 0.0, 1)], [(0.0, 0.0, -1, 0, False, 2, -1, [1]), (2.0, 0.0, -1, 0, False, 2, -1, [0])])]
    schema = "path string, nodes array<struct<x:float,z:float,rot_x:float,rot_z:float,lane_count:int>>, map_points array<struct<x:float,z:float,lane_count:int,lane_offset:int,hidden:boolean,color_flags:int,control_node:int,neighbours:array<int>>>"
    prefabs = spark.createDataFrame(prefab, schema)
    nodes = spark.createDataFrame([(9, 100.0, 50.0, math.pi / 2)], "uid long, x float, z float, rotation float")
    items = spark.createDataFrame([(1, "p", 0, 9, 5)], "uid long, path string, origin int, node_uid long, load_seq long")
    rows = polygons.placed(items, prefabs, nodes).orderBy("look_no").collect()
    got = [(round(p["x"], 3), round(p["z"], 3)) for p in rows[0]["points"]]
    assert len(rows) == 2 and got == [(101.0, 50.0), (99.0, 50.0)] or got == [(99.0, 50.0), (101.0, 50.0)]


def test_ferry_curve(spark):
    rows = [([],), ([(10.0, 0.0, 0.0), (10.0, 10.0, 1.5)],)]
    df = spark.createDataFrame(rows, "points array<struct<x:double,z:double,rot:double>>")
    end = lambda x, z: F.struct(F.lit(x).alias("x"), F.lit(z).alias("z"))
    out = [r[0] for r in df.select(geometry.ferry_curve(end(0.0, 0.0), F.col("points"), end(30.0, 40.0))).collect()]
    straight, curved = sorted(out, key=len)
    assert len(straight) == 1 and (straight[0]["c0x"], straight[0]["c1z"]) == (0.0, 40.0)
    assert len(curved) == 3 and curved[0]["c0x"] == pytest.approx(10 / 3) and curved[0]["c1x"] == pytest.approx(10 - 10 / 3)
    assert (curved[2]["x0"], curved[2]["x1"]) == (10.0, 30.0)


def test_fit_and_tile_info(spark, tmp_path):
    pts = spark.createDataFrame([(0.0, 0.0), (100.0, 40.0)], "x double, z double")
    scale, x, z = geometry.fit_map(F.lit(0.0), F.lit(100.0), F.lit(0.0), F.lit(40.0), 10.0, 240.0, 240.0)
    row = spark.range(1).select(scale.alias("s"), x.alias("x"), z.alias("z")).first()
    assert tuple(row) == (2.0, -10.0, -40.0)
    info = exports.tile_map_info(pts, 0, 3, str(tmp_path / "info.json"))
    assert info == {"x1": 0.0, "x2": 100.0, "y1": -30.0, "y2": 70.0, "minZoom": 0, "maxZoom": 3}


def test_exports(spark):
    items = spark.createDataFrame([(5, 1.0, 2.0, False), (5, 3.0, 4.0, True)], "look_token long, x float, z float, hidden boolean")
    cities = spark.createDataFrame([(5, "Alpha", "a", "beta", None)], "token long, name string, loc_token string, country string, localized_names map<string,string>")
    from cartolyte.functions.tokens import token

    land = spark.createDataFrame([("beta", 7)], "n string, country_id int").select(token(F.col("n")).alias("token"), "country_id")
    got = exports.cities(items, cities, land).collect()
    assert [(r["Name"], r["CountryId"], r["X"], r["Y"]) for r in got] == [("Alpha", 7, 1.0, 2.0)]
    labels = spark.createDataFrame([(3,), (13,)], "c int").select(exports.spawn_label(F.col("c")).alias("s")).collect()
    assert labels[0]["s"]["label"] == "Fuel" and labels[1]["s"] is None
