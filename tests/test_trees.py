"""Folder listings, nested includes and tile pyramids against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cartolyte.operators import pyramid
from cartolyte.sources import trees


def files_of(spark, texts):
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "path string, content binary")


def expanded(texts, path, trail=()):
    """(source, line) in order."""
    out = []
    for line in texts[path].split("\n"):
        target = "def/" + line.split('"')[1] if line.lstrip().startswith("@include") and line.count('"') > 1 else None
        if target in texts:
            if target not in (*trail, path):
                out += expanded(texts, target, (*trail, path))
        else:
            out.append((path, line))
    return out


def test_nested_includes(spark):
    rng = random.Random(5)
    names = [f"def/f{i}.sui" for i in range(9)]
    texts = {n: "\n".join(f'@include "{rng.choice(names + ["def/none.sui"])[4:]}"' if rng.random() < 0.25 else f"line {rng.randrange(99)}" for _ in range(6)) for n in names}
    texts |= {"def/own.sii": 'a\n@include "own.sii"\nb', "def/twice.sii": '@include "leaf.sui"\n@include "leaf.sui"', "def/leaf.sui": "x\ny", "def/empty.sii": "", "def/bad.sii": "@include nothing\n@include"}
    out = trees.expand_nested(files_of(spark, texts), F.col("path").isin(*texts))
    got = {}
    for r in out.collect():
        got.setdefault(r["path"], []).append((r["at"], r["source"], r["line"]))
    for path in texts:
        assert [(s, line) for _, s, line in sorted(got.get(path, []))] == expanded(texts, path)
    assert "UnionLoop" in out._jdf.queryExecution().optimizedPlan().toString()


def test_includes_end_at_a_cycle_of_three(spark):
    texts = {"def/a.sii": 'a\n@include "b.sui"', "def/b.sui": 'b\n@include "c.sui"', "def/c.sui": 'c\n@include "a.sii"'}
    rows = trees.expand_nested(files_of(spark, texts), F.col("path") == "def/a.sii").collect()
    assert sorted((tuple(r["at"]), r["source"], r["line"]) for r in rows) == [((0,), "def/a.sii", "a"), ((1, 0), "def/b.sui", "b"), ((1, 1, 0), "def/c.sui", "c")]
    assert trees.expand_nested(files_of(spark, texts), F.col("path") == "def/none").collect() == []


def test_listings(spark):
    rows = [("", "*def"), ("", "a.txt"), ("", "*gone"), ("def", "*x"), ("def", "b.txt"), ("def", "b.txt"), ("def", ""), ("def", "*"), ("def/x", "c.txt"), ("other", "d.txt"), ("a.txt", "e.txt")]
    found = trees.listed(spark.createDataFrame(rows, "folder string, line string"))
    assert sorted(map(tuple, found.collect())) == [("a.txt", 1, False), ("def", 1, True), ("def/b.txt", 2, False), ("def/x", 2, True), ("def/x/c.txt", 3, False), ("gone", 1, True)]
    below = trees.listed(spark.createDataFrame(rows, "folder string, line string"), "def")
    assert sorted(r["path"] for r in below.collect()) == ["def/b.txt", "def/x", "def/x/c.txt"]


LOW, SIDE = -100.0, 256.0


def meets(x0, z0, x1, z1, low_x, high_x, low_z, high_z):
    """A side meets a box: the parts of it within the box's width and height overlap."""
    begin, end = 0.0, 1.0
    for a, b, low, high in ((x0, x1, low_x, high_x), (z0, z1, low_z, high_z)):
        if a == b:
            if not low <= a < high:
                return False
        else:
            t = sorted(((low - a) / (b - a), (high - a) / (b - a)))
            begin, end = max(begin, t[0]), min(end, t[1])
    return begin <= end


def within(points, x, z):
    inside = False
    for (ax, az), (bx, bz) in zip(points, points[1:] + points[:1]):
        if (az <= z) != (bz <= z) and ax + (z - az) * (bx - ax) / (bz - az) <= x:
            inside = not inside
    return inside


def brute_tiles(things, zoom, margin):
    n, step, out = 1 << zoom, SIDE / (1 << zoom), set()
    for number, closed, points in things:
        points = [p for p in points if None not in p]
        sides = list(zip(points, points[1:] + points[:1])) if closed else list(zip(points, points[1:] or points))
        for tx in range(n):
            for ty in range(n):
                bx, bz = LOW + tx * step, LOW + ty * step
                if any(meets(*a, *b, bx - margin, bx + step + margin, bz - margin, bz + step + margin) for a, b in sides) or closed and within(points, bx + step / 2, bz + step / 2):
                    out.add((number, tx, ty))
    return out


@pytest.mark.parametrize("margin", [0.0, 7.3])
def test_pyramid(spark, tmp_path, margin):
    rng = random.Random(12)
    at = lambda far=150.0: (rng.uniform(-far, far), rng.uniform(-far, far))
    things = [(i, False, [at() for _ in range(rng.randint(1, 6))]) for i in range(40)]
    things += [(100 + i, True, [at() for _ in range(rng.randint(3, 7))]) for i in range(25)]
    things += [(200, False, []), (201, True, []), (202, True, [(5.5, 6.5)]), (203, False, [(-9999.0, -9999.0), (9999.0, 9998.0)]), (204, False, [(1.5, 2.5), (None, 3.0), (90.5, 2.5)]), (205, True, [(-999.0, -999.0), (999.0, -999.0), (999.0, 999.0), (-999.0, 999.0)]), (206, False, [(3.3, -500.0), (3.3, 500.0)])]
    rows = spark.createDataFrame(things, "id long, closed boolean, points array<struct<x:double,z:double>>")
    out = pyramid.write_pyramid(rows, range(5), LOW, SIDE, margin, str(tmp_path / "tiles"))
    tx, ty = pyramid.tile_of(F.col("key"))
    got = {}
    for r in out.select("zoom", "id", tx.alias("tx"), ty.alias("ty")).collect():
        got.setdefault(r["zoom"], []).append((r["id"], r["tx"], r["ty"]))
    for zoom in range(5):
        assert len(got[zoom]) == len(set(got[zoom])) and set(got[zoom]) == brute_tiles(things, zoom, margin)
    assert sorted(p.name for p in (tmp_path / "tiles").iterdir()) == [f"zoom={z}" for z in range(5)]
    one = spark.read.parquet(str(tmp_path / "tiles")).where("zoom = 4 AND key = 7")
    assert "PartitionFilters: [isnotnull(zoom" in one._jdf.queryExecution().executedPlan().toString()


def test_keys_round_trip(spark):
    rows = spark.range(1 << 12).select((F.col("id") * 16 + 7).alias("tx"), (65535 - F.col("id") * 3).alias("ty"))
    tx, ty = pyramid.tile_of(pyramid.tile_key(F.col("tx"), F.col("ty")))
    assert rows.where((tx != F.col("tx")) | (ty != F.col("ty"))).count() == 0
    with pytest.raises(ValueError):
        pyramid.finest(rows, 17, 0.0, 1.0)
