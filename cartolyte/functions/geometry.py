"""Plane geometry as Column expressions in DOUBLE."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest visible side below which a zoom index holds (fixed values).
ZOOM_SIDES = (1000, 5000, 18500)
#: Caps of the zoom indices (fixed values).
ZOOM_CAPS = (1000, 5000, 18500, 45000)
#: Points of a drawn road (fixed value).
ROAD_POINTS = 8
#: Width of a lane (fixed value).
LANE = 4.5


def rotate(x: Column, z: Column, angle: Column, cx: Column, cz: Column) -> tuple[Column, Column]:
    """A point turned about a centre."""
    dx, dz = x - cx, z - cz
    return cx + dx * F.cos(angle) - dz * F.sin(angle), cz + dx * F.sin(angle) + dz * F.cos(angle)


def corner(x: Column, z: Column, width: Column, angle: Column) -> tuple[Column, Column]:
    """The point at a distance in a direction."""
    return x + width * F.cos(angle), z + width * F.sin(angle)


def length(dx: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dz * dz)


def control_offset(dx: Column, dz: Column, angle: Column) -> tuple[Column, Column]:
    """Of a cubic curve's control point: a third of the chord along the direction."""
    third = length(dx, dz) / 3
    return F.cos(angle) * third, F.sin(angle) * third


def hermite(s: Column, p0: Column, p1: Column, t0: Column, t1: Column) -> Column:
    """The cubic with given ends and tangents at parameter s."""
    s2, s3 = s * s, s * s * s
    return (2 * s3 - 3 * s2 + 1) * p0 + (3 * s2 - 2 * s3) * p1 + (s3 - 2 * s2 + s) * t0 + (s3 - s2) * t1


def node_rotation(rx: Column, rz: Column) -> Column:
    """The heading of a node from its stored components; the remainder truncates."""
    return ((F.lit(math.pi) - F.atan2(rz, rx)) % F.lit(math.pi)) * 2


def placement_angle(rotation: Column, rot_x: Column, rot_z: Column) -> Column:
    return rotation - F.lit(math.pi) - F.atan2(rot_z, rot_x) + F.lit(math.pi / 2)


def road_points(start: Column, end: Column, n: int = ROAD_POINTS) -> Column:
    """``n`` points (x, z) of a road as an array, from nodes (x, z, rotation): the tangents are the chord's length along each node's heading."""
    chord = length(start["x"] - end["x"], start["z"] - end["z"])
    heading = lambda node: node["rotation"] - math.pi / 2
    # A list of one binds what all points of a road share, so that it is computed once a road.
    shared = F.array(F.struct(*((f(heading(node)) * chord).alias(f"{name}{k}") for k, node in enumerate((start, end)) for name, f in (("x", F.cos), ("z", F.sin)))))

    def at(i: Column, t: Column) -> Column:
        s = i / F.lit(n - 1.0)
        x = hermite(s, start["x"], end["x"], t["x0"], t["x1"])
        z = hermite(s, start["z"], end["z"], t["z0"], t["z1"])
        return F.struct(x.alias("x"), z.alias("z"))

    return F.flatten(F.transform(shared, lambda t: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: at(i, t))))


def label_position(node: Column, x: Column, z: Column, x_offsets: Column, y_offsets: Column, zoom: int, scale: float) -> tuple[Column, Column]:
    """Where a city's label is: at its node, else its own place, moved by the zoom's offsets if both lists have one."""
    moved = lambda offsets: F.when((F.size(x_offsets) > zoom) & (F.size(y_offsets) > zoom), F.get(offsets, F.lit(zoom)) / F.lit(scale * ZOOM_CAPS[zoom]))
    return F.coalesce(node["x"], x) + F.coalesce(moved(x_offsets), F.lit(0.0)), F.coalesce(node["z"], z) + F.coalesce(moved(y_offsets), F.lit(0.0))


def zoom_index(width: Column, height: Column) -> Column:
    side = F.least(width, height)
    chosen = F.when(side < ZOOM_SIDES[0], 0)
    for i, limit in enumerate(ZOOM_SIDES[1:], 1):
        chosen = chosen.when(side < limit, i)
    return chosen.otherwise(len(ZOOM_SIDES))


def road_width(offset: Column, lanes_left: Column, lanes_right: Column) -> Column:
    return offset + F.size(lanes_left) * LANE + F.size(lanes_right) * LANE


def ferry_curve(start: Column, points: Column, end: Column) -> Column:
    """The segments of a ferry line as an array of structs (x0, z0, c0x, c0z, c1x, c1z, x1, z1).

    ``start`` and ``end`` are structs (x, z), ``points`` an array of (x, z, rot). The ports head for the nearest point.
    Without points there is one straight segment, whose control points are its ends.
    """
    yaw = lambda a, b: F.atan2(b["z"] - a["z"], b["x"] - a["x"])
    node = lambda p, rot: F.struct(p["x"].cast("double").alias("x"), p["z"].cast("double").alias("z"), rot.cast("double").alias("rot"))
    straight = F.size(points) == 0
    first, last = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    head = F.when(straight, yaw(start, end)).otherwise(yaw(start, first))
    tail = F.when(straight, yaw(start, end)).otherwise(yaw(last, end))
    nodes = F.concat(F.array(node(start, head)), F.transform(points, lambda p: node(p, p["rot"])), F.array(node(end, tail)))

    def segment(a: Column, b: Column) -> Column:
        ax, az = control_offset(b["x"] - a["x"], b["z"] - a["z"], a["rot"])
        bx, bz = control_offset(b["x"] - a["x"], b["z"] - a["z"], b["rot"])
        none = F.lit(0.0)
        ax, az, bx, bz = (F.when(straight, none).otherwise(c) for c in (ax, az, bx, bz))
        fields = {"x0": a["x"], "z0": a["z"], "c0x": a["x"] + ax, "c0z": a["z"] + az, "c1x": b["x"] - bx, "c1z": b["z"] - bz, "x1": b["x"], "z1": b["z"]}
        return F.struct(*(c.alias(k) for k, c in fields.items()))

    return F.transform(F.sequence(F.lit(1), F.size(nodes) - 1), lambda i: segment(F.element_at(nodes, i), F.element_at(nodes, i + 1)))


def fit_map(min_x, max_x, min_z, max_z, padding: float, width: float, height: float) -> tuple[Column, Column, Column]:
    """(scale, x, z): the larger padded side fills its target side; the other axis is centred."""
    w, h = max_x - min_x + 2 * padding, max_z - min_z + 2 * padding
    wide = w > h
    scale = F.when(wide, F.lit(width) / w).otherwise(F.lit(height) / h)
    x = min_x - padding + F.when(wide, F.lit(0.0)).otherwise((w - F.lit(width) / scale) / 2)
    z = min_z - padding + F.when(wide, (h - F.lit(height) / scale) / 2).otherwise(F.lit(0.0))
    return scale, x, z
