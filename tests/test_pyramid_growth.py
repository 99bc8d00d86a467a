"""What a tile pyramid costs as its things grow, and that each zoom, made from the sides, is that of the one below."""

import random

import pytest

from cartolyte.operators import pyramid

SCHEMA = "id long, closed boolean, points array<struct<x:double,z:double>>"


def stages(spark):
    store, none = spark._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    found = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return {(s.stageId(), s.attemptId()): (s.shuffleWriteRecords(), s.numTasks()) for s in (found.apply(i) for i in range(found.size()))}


def keys(out):
    found = {}
    for r in out.collect():
        found.setdefault(r["zoom"], []).append((r["id"], r["key"]))
    assert all(len(set(v)) == len(v) for v in found.values())
    return {zoom: set(v) for zoom, v in found.items()}


def test_rows_of_tiles_are_shuffled_once(spark, tmp_path):
    rng = random.Random(4)
    at = lambda: (rng.uniform(-90.0, 90.0), rng.uniform(-90.0, 90.0))
    n = 2000
    lines = spark.createDataFrame([(i, False, [at(), at()]) for i in range(n)], SCHEMA).coalesce(1)
    before = stages(spark)
    out = pyramid.write_pyramid(lines, range(5), -100.0, 200.0, 2.0, str(tmp_path / "tiles"))
    made = [v for k, v in stages(spark).items() if k not in before]
    tiles = out.count()
    assert tiles > 10 * n
    # Twice for each zoom before.
    assert tiles <= sum(records for records, _ in made) <= tiles + 4 * n
    # One task made all of them before.
    assert max(tasks for records, tasks in made if records > n) > 1


@pytest.mark.parametrize("margin", [0.0, 3.3])
def test_zooms_are_those_of_the_one_below(spark, tmp_path, margin):
    rng = random.Random(9)
    at = lambda: (rng.uniform(-400.0, 500.0), rng.uniform(-400.0, 500.0))
    things = [(i, i % 5 == 4, [at() for _ in range(1 + i % 5)]) for i in range(60)]
    rows = spark.createDataFrame(things, SCHEMA)
    found = keys(pyramid.write_pyramid(rows, range(1, 8, 2), -1000 / 3, 777.7, margin, str(tmp_path / "tiles")))
    assert sorted(found) == [1, 3, 5, 7]
    assert found[7] == {tuple(r) for r in pyramid.finest(rows, 7, -1000 / 3, 777.7, margin).select("id", "key").collect()}
    for zoom in (5, 3, 1):
        assert found[zoom] == {(i, key >> 4) for i, key in found[zoom + 2]}


def test_parts_of_one_thing(spark, tmp_path):
    """Rows of the same id are one thing, in a tile once."""
    parts = [(1, False, [(5.0, 5.0), (95.0, 95.0)]), (1, False, [(5.0, 5.0), (95.0, 95.0)]), (1, False, [(5.0, 95.0), (95.0, 5.0)]), (2, None, [(5.0, 5.0), (95.0, 5.0)]), (3, False, None), (4, True, None)]
    found = keys(pyramid.write_pyramid(spark.createDataFrame(parts, SCHEMA), range(3), 0.0, 100.0, 0.0, str(tmp_path / "tiles")))
    assert found[0] == {(1, 0), (2, 0)}
    assert {key for i, key in found[2] if i == 2} == {0, 1, 4, 5}
    assert {key for i, key in found[2] if i == 1} >= {0, 3, 12, 15, 5, 6, 9, 10}


def test_no_things(spark, tmp_path):
    out = pyramid.write_pyramid(spark.createDataFrame([], SCHEMA), range(3), 0.0, 100.0, 0.0, str(tmp_path / "tiles"))
    assert set(out.columns) == {"zoom", "key", "id"} and out.count() == 0
