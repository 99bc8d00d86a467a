"""Polygons of prefabs by folds, against loops."""

import math
import random

from cartolyte.functions.geometry import LANE
from cartolyte.operators import polygons
from cartolyte.schemas import PREFABS

COLORS = ((2, "light"), (4, "dark"), (8, "green"))


def brute_walk(points: list, start: int) -> list[int]:
    """The vertices met by always going to the first neighbour not yet met; the start isn't met at first."""
    met, at = [], start
    while True:
        following = next((n for n in points[at]["neighbours"] if n not in met), None)
        if following is None:
            return met
        met.append(following)
        at = following


def lanes_of(index: int, point, nodes: list) -> int:
    """-2 stands for the control node's count, where the point has one."""
    if point["lane_count"] == -2 and index < len(nodes) and point["control_node"] != -1:
        return nodes[point["control_node"]]["lane_count"]
    return point["lane_count"]


def quad(a, b, lanes_a: int, lanes_b: int) -> list[tuple[float, float]]:
    yaw = math.atan2(b["z"] - a["z"], b["x"] - a["x"])

    def corner(p, lanes: int, offset: int, turn: float) -> tuple[float, float]:
        half = (LANE * lanes + offset) / 2
        return p["x"] + half * math.cos(yaw + turn), p["z"] + half * math.sin(yaw + turn)

    left, right = math.pi / 2, -math.pi / 2
    return [corner(a, lanes_a, a["lane_offset"], left), corner(b, lanes_b, b["lane_offset"], left), corner(b, lanes_b, a["lane_offset"], right), corner(a, lanes_a, a["lane_offset"], right)]


def brute_looks(nodes: list, points: list) -> list[tuple[int, str, list[tuple[float, float]]]]:
    """(z, colour, vertices) of a prefab's shapes, in its own coordinates, in order."""
    looks = []
    for i, point in enumerate(points):
        if point["lane_count"] == -1:
            met = brute_walk(points, i)
            if len(met) >= 2:
                flags = points[met[0]]["color_flags"]
                color = next((name for bit, name in COLORS if flags & bit), "light")
                looks.append((3 if flags & 1 else 2, color, [(points[n]["x"], points[n]["z"]) for n in met]))
            continue
        own = lanes_of(i, point, nodes)
        for n in point["neighbours"]:
            other = points[n]
            if n <= i or (point["hidden"] or other["hidden"]) and len(nodes) + 1 < len(points):
                continue
            theirs = lanes_of(n, other, nodes)
            # What one end lacks comes from the other; the own count holds for the neighbours after.
            own = theirs if own == -2 else own
            own = 1 if own == -2 else own
            looks.append((4, "road", quad(point, other, own, own if theirs == -2 else theirs)))
    return looks


def prefab(rng: random.Random, n: int) -> tuple[list, list]:
    nodes = [{"x": 0.0, "z": 0.0, "rot_x": 1.0, "rot_z": 0.0, "lane_count": rng.choice([1, 2, 3, -2])} for _ in range(rng.randrange(4))]
    near = lambda: rng.sample(range(n), rng.randrange(min(n, 6) + 1))
    control = lambda: rng.choice([-1, *range(len(nodes))])
    points = [
        {"x": rng.randrange(-40, 40) / 4, "z": rng.randrange(-40, 40) / 4, "lane_count": rng.choice([-1, -1, -2, -2, 1, 2, 4]), "lane_offset": rng.choice([0, 1, 5]), "hidden": rng.random() < 0.2, "color_flags": rng.randrange(16), "control_node": control(), "neighbours": near()}
        for _ in range(n)
    ]
    return nodes, points


def test_folds_equal_loops(spark):
    rng = random.Random(3)
    made = {f"p{k}": prefab(rng, n) for k, n in enumerate([0, 1, 2, 3, 4, 5, 6, 8, 12, 31, 32, 33, 40, 70] * 4)}
    rows = [(path, True, nodes, [], points, []) for path, (nodes, points) in made.items()]
    out = polygons.shapes(spark.createDataFrame(rows, PREFABS))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Exchange" not in plan
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["look_no"]):
        got.setdefault(r["path"], []).append((r["z_index"], r["color"], [(round(p["x"], 6), round(p["z"], 6)) for p in r["points"]]))
    want = {path: [(z, c, [(round(x, 6), round(y, 6)) for x, y in v]) for z, c, v in brute_looks(nodes, points)] for path, (nodes, points) in made.items()}
    assert got == {path: looks for path, looks in want.items() if looks} and sum(map(len, got.values())) > 500


def test_walks_equal_loops(spark):
    rng = random.Random(8)
    graphs = [[[rng.randrange(n) for _ in range(rng.randrange(4))] for _ in range(n)] for n in (1, 2, 5, 33, 64, 100)]
    rows = [(i, s, [{"neighbours": near} for near in g]) for i, g in enumerate(graphs) for s in range(len(g))]
    df = spark.createDataFrame(rows, "i int, s int, points array<struct<neighbours:array<int>>>")
    for r in df.select("i", "s", polygons.walk(df["points"], df["s"]).alias("met")).collect():
        assert r["met"] == brute_walk([{"neighbours": near} for near in graphs[r["i"]]], r["s"])
