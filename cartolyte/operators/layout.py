"""Tables of points clustered along a Morton curve, and viewports as ranges of its keys.

A point's key interleaves the bits of its cell in a square of 2^bits by 2^bits cells. A table sorted by key keeps near
points in near rows, so the least and greatest key of each Parquet row group tell a scan which groups it can leave out. A
rectangle becomes a few ranges of keys, which Spark pushes into that scan; the inequalities on x and z decide after it.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolyte.operators.spatial import MARGIN, in_viewport

#: Column of the keys, and ranges that a viewport has at most.
KEY, RANGES = "morton", 32
#: Masks that spread the low 16 bits of a number to the even ones, with their shifts.
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


class Square(NamedTuple):
    """What the cells cover. Points beyond it belong to the cells at its edge."""

    low_x: float
    low_z: float
    side: float
    bits: int = 16

    def column(self, value: Column, low: float) -> Column:
        at = F.floor((value - F.lit(float(low))) / F.lit(self.side / (1 << self.bits)))
        return F.when(value.isNotNull(), F.greatest(F.least(at, F.lit((1 << self.bits) - 1)), F.lit(0))).cast("long")

    def cell(self, value: float, low: float) -> int:
        """The same for one value: a value's cell is never left of a smaller one's."""
        at = (value - low) / (self.side / (1 << self.bits))
        return int(min(max(math.floor(min(max(at, -1.0), 2.0**40)), 0), (1 << self.bits) - 1))


def _spread(cell: Column) -> Column:
    for shift, mask in _SPREAD:
        cell = cell.bitwiseOR(F.shiftleft(cell, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return cell


def morton(x: Column, z: Column, square: Square) -> Column:
    """The key of a point, null where a coordinate is: the bits of x at even places, those of z at odd ones."""
    return _spread(square.column(x, square.low_x)).bitwiseOR(F.shiftleft(_spread(square.column(z, square.low_z)), 1))


def square_of(points: DataFrame, bits: int = 16) -> Square:
    """The least square around all points."""
    x0, x1, z0, z1 = points.agg(F.min("x"), F.max("x"), F.min("z"), F.max("z")).first()
    return Square(0.0, 0.0, 1.0, bits) if x0 is None else Square(x0, z0, max(x1 - x0, z1 - z0) or 1.0, bits)


def write_clustered(points: DataFrame, path: str, square: Square, group_bytes: int = 16 << 20) -> None:
    """Points (x, z, ...) with their keys, sorted by them, as Parquet with row groups of about so many bytes.

    One exchange by sampled ranges of keys, then a sort in each; a cell with very many points stays in one file's neighbours.
    """
    keyed = points.withColumn(KEY, morton(F.col("x"), F.col("z"), square))
    ranged = keyed.repartitionByRange(KEY, "x", "z").sortWithinPartitions(KEY)
    ranged.write.option("parquet.block.size", group_bytes).option("parquet.page.size", min(group_bytes, 1 << 20)).parquet(path)


def key_ranges(x0: float, z0: float, x1: float, z1: float, square: Square, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges of keys, both ends included, that hold the keys of all points of a rectangle.

    The square is quartered level by level: a quarter inside the rectangle is one range, one outside none, and others are
    quartered on, as long as there are few of them. Then the ranges with the smallest gaps join.
    """
    left, right = square.cell(x0, square.low_x), square.cell(x1, square.low_x)
    bottom, top = square.cell(z0, square.low_z), square.cell(z1, square.low_z)
    whole, open_ = [], [(0, 0, 0)]  # (key, x, z) of the first cell of a square
    for level in range(square.bits, -1, -1):
        width, partly = 1 << level, []
        for key, x, z in open_:
            if x > right or x + width <= left or z > top or z + width <= bottom:
                continue
            if left <= x and x + width - 1 <= right and bottom <= z and z + width - 1 <= top:
                whole.append((key, key + width * width - 1))
            else:
                partly.append((key, x, z))
        if not partly or len(whole) + 4 * len(partly) > 8 * most:
            whole += [(key, key + width * width - 1) for key, _, _ in partly]
            break
        half = width // 2
        open_ = [(key + q * half * half, x + (q & 1) * half, z + (q >> 1) * half) for key, x, z in partly for q in range(4)]
    joined: list[list[int]] = []
    for a, b in sorted(whole):
        if joined and a == joined[-1][1] + 1:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    gaps = sorted(range(1, len(joined)), key=lambda i: joined[i][0] - joined[i - 1][1], reverse=True)
    cuts = sorted(gaps[: most - 1])
    return [(joined[i][0], joined[j - 1][1]) for i, j in zip([0, *cuts], [*cuts, len(joined)]) if joined]


def in_ranges(key: Column, ranges: list[tuple[int, int]]) -> Column:
    found = F.lit(False)
    for i, (a, b) in enumerate(ranges):
        one = (key >= a) & (key <= b)
        found = one if i == 0 else found | one
    return found


def viewport(table: DataFrame, square: Square, x0: float, z0: float, x1: float, z1: float, margin: float = MARGIN) -> DataFrame:
    """The rows of a clustered table in a viewport and its margin, all edges included."""
    ranges = key_ranges(x0 - margin, z0 - margin, x1 + margin, z1 + margin, square)
    return table.where(in_ranges(F.col(KEY), ranges) & in_viewport(F.col("x"), F.col("z"), x0, z0, x1, z1, margin))
