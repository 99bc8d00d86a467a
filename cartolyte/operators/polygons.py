"""Polygons of prefabs: areas by walking along map points, roads as quads between them.

Shapes depend on the prefab alone, of which there are few, so they are made once for each definition; items then join
their definition's shapes and turn them into place by expressions. Walks and lane counts are folds over arrays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolyte.functions.geometry import LANE, placement_angle, rotate

_COLORS = ((2, "light"), (4, "dark"), (8, "green"))
#: Bits of a word of a set of points.
_BITS = 32


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n % _BITS)


def walk(points: Column, start: Column) -> Column:
    """The vertices met by always going to the first neighbour not yet met; the start isn't met at first.

    A fold with as many steps as there are points, over the vertices met, as a list and as a bitmap, and the current one,
    which is null when there is nowhere to go.
    """
    none = F.array_repeat(F.lit(0).cast("long"), F.ceil(F.size(points) / _BITS).cast("int"))
    state = lambda met, bits, at: F.struct(met.alias("met"), bits.alias("bits"), at.alias("at"))

    def step(acc: Column, _: Column) -> Column:
        new = lambda n: F.get(acc["bits"], F.floor(n / _BITS).cast("int")).bitwiseAND(_bit(n)) == 0
        following = F.get(F.filter(F.get(points, acc["at"])["neighbours"], new), F.lit(0))
        # Bound to a name by a list of one, as an expression would be evaluated wherever it stands.
        moved = F.transform(
            F.array(following),
            lambda n: F.when(n.isNull(), state(acc["met"], acc["bits"], n)).otherwise(
                state(F.concat(acc["met"], F.array(n)), F.transform(acc["bits"], lambda w, k: F.when(k == F.floor(n / _BITS), w.bitwiseOR(_bit(n))).otherwise(w)), n)
            ),
        )
        return F.when(acc["at"].isNull(), acc).otherwise(F.get(moved, F.lit(0)))

    begin = state(F.slice(F.array(F.lit(0)), 1, 0), none, start)
    return F.aggregate(F.sequence(F.lit(1), F.size(points)), begin, step, lambda acc: acc["met"])


def _lanes(index: Column, point: Column, nodes: Column) -> Column:
    """-2 stands for the control node's count, where the point has one."""
    control = (point["lane_count"] == -2) & (index < F.size(nodes)) & (point["control_node"] != -1)
    return F.when(control, F.get(nodes, point["control_node"])["lane_count"]).otherwise(point["lane_count"])


def _vertex(x: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), z.cast("double").alias("z"))


def _look(z: Column, color: Column, points: Column) -> Column:
    return F.struct(z.cast("int").alias("z_index"), color.alias("color"), points.alias("points"))


def _quad(a: Column, b: Column, lanes_a: Column, lanes_b: Column) -> Column:
    wide = lambda p: (p["x"].cast("double"), p["z"].cast("double"))
    (ax, az), (bx, bz) = wide(a), wide(b)
    yaw = F.atan2(bz - az, bx - ax)

    def corner(x: Column, z: Column, lanes: Column, offset: Column, turn: float) -> Column:
        half = (LANE * lanes + offset) / 2
        return _vertex(x + half * F.cos(yaw + turn), z + half * F.sin(yaw + turn))

    left, right = math.pi / 2, -math.pi / 2
    return F.array(corner(ax, az, lanes_a, a["lane_offset"], left), corner(bx, bz, lanes_b, b["lane_offset"], left), corner(bx, bz, lanes_b, a["lane_offset"], right), corner(ax, az, lanes_a, a["lane_offset"], right))


def _area(points: Column, met: Column) -> Column:
    """An array of the area's look, empty if fewer than two vertices were met."""
    flags = F.get(points, F.get(met, F.lit(0)))["color_flags"]
    color = F
    for bit, name in _COLORS:
        color = color.when(flags.bitwiseAND(F.lit(bit)) != 0, name)
    at = F.transform(met, lambda n: _vertex(F.get(points, n)["x"], F.get(points, n)["z"]))
    one = F.array(_look(F.when(flags.bitwiseAND(F.lit(1)) != 0, 3).otherwise(2), color.otherwise("light"), at))
    return F.when(F.size(met) >= 2, one).otherwise(F.slice(one, 1, 0))


def _roads(nodes: Column, points: Column, point: Column, i: Column) -> Column:
    """The looks of the roads to a point's later neighbours, by a fold over them: what one end's lane count lacks comes from the other, and the own count holds for the neighbours after."""
    crowded = F.size(nodes) + 1 < F.size(points)
    none = F.slice(F.array(_look(F.lit(4), F.lit("road"), F.array(_vertex(F.lit(0.0), F.lit(0.0))))), 1, 0)
    state = lambda own, looks: F.struct(own.cast("int").alias("own"), looks.alias("looks"))

    def step(acc: Column, n: Column) -> Column:
        other = F.get(points, n)
        theirs = _lanes(n, other, nodes)
        own = F.when(acc["own"] != -2, acc["own"]).when(theirs != -2, theirs).otherwise(1)
        look = _look(F.lit(4), F.lit("road"), _quad(point, other, own, F.when(theirs == -2, own).otherwise(theirs)))
        skipped = (n <= i) | ((point["hidden"] | other["hidden"]) & crowded)
        return F.when(skipped, acc).otherwise(state(own, F.concat(acc["looks"], F.array(look))))

    return F.aggregate(point["neighbours"], state(_lanes(i, point, nodes), none), step, lambda acc: acc["looks"])


def shapes(prefabs: DataFrame) -> DataFrame:
    """(path, look_no, z_index, color, points): a row for each shape of each prefab definition, in its own coordinates."""
    nodes, points = F.col("nodes"), F.col("map_points")
    # Walks are made in a column of their own, so that each is walked once.
    walked = prefabs.select("path", "nodes", "map_points", F.transform(points, lambda p, i: F.when(p["lane_count"] == -1, walk(points, i))).alias("walks"))
    looks = F.flatten(F.transform(points, lambda p, i: F.when(p["lane_count"] == -1, _area(points, F.get("walks", i))).otherwise(_roads(nodes, points, p, i))))
    return walked.select("path", F.posexplode(looks).alias("look_no", "look")).select("path", "look_no", "look.*")


def framed(items: DataFrame, prefabs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Prefab items (path, origin, node_uid) with their definition's columns and ``frame``, which :func:`turned` needs."""
    origin = prefabs.select("*", F.posexplode("nodes").alias("origin", "own"))
    held = items.join(origin, ["path", "origin"]).join(nodes.select(F.col("uid").alias("node_uid"), F.col("x").alias("nx"), F.col("z").alias("nz"), "rotation"), "node_uid")
    angle = placement_angle(F.col("rotation"), F.col("own.rot_x"), F.col("own.rot_z"))
    frame = F.struct("nx", "nz", F.col("own.x").alias("ox"), F.col("own.z").alias("oz"), angle.alias("angle"))
    return held.withColumn("frame", frame).drop("own", "nx", "nz", "rotation")


def turned(frame, p):
    """A prefab's point as it lies on the map."""
    x, z = rotate(frame["nx"] - frame["ox"] + p["x"], frame["nz"] - frame["oz"] + p["z"], frame["angle"], frame["nx"], frame["nz"])
    return F.struct(x.alias("x"), z.alias("z"))


def placed(items: DataFrame, prefabs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(uid, z_index, load_seq, look_no, color, points): the shapes of prefab items (uid, path, origin, node_uid, load_seq) in place.

    Draw them by z_index, load_seq, look_no.
    """
    held = framed(items, prefabs.select("path", "nodes"), nodes).join(shapes(prefabs), "path")
    return held.select("uid", "z_index", "load_seq", "look_no", "color", F.transform("points", lambda p: turned(F.col("frame"), p)).alias("points"))
