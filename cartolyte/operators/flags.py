"""Flags, hidden items and code-to-label choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guard values above which content is hidden, by game (fixed values).
GUARD = {"ets2": 12, "ats": 19}
#: Code to number tables of map points (fixed values).
LANES = {0: 1, 1: 2, 2: 4, 3: 6, 4: 8, 5: 5, 6: 7, 8: 3, 13: -1, 14: -2}
LANE_OFFSETS = {1: 1, 2: 2, 3: 5, 4: 10, 5: 15, 6: 20, 7: 25}
CONTROL_NODES = {1: 0, 2: 1, 4: 2, 8: 3, 16: 4, 32: 5}


def has_all(flags: Column, mask: int | Column) -> Column:
    """All bits of the mask are set."""
    mask = F.lit(mask) if isinstance(mask, int) else mask
    return flags.bitwiseAND(mask) == mask


def has_any(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def hidden_road(guard: Column, flags: Column, game: str = "ets2") -> Column:
    """Of roads and prefabs: the guard is above the game's, or bit 2 is set."""
    return (guard > GUARD[game]) | has_any(flags, 0x02)


def hidden_overlay(guard: Column, visibility: Column, game: str = "ets2") -> Column:
    return (guard > GUARD[game]) | (visibility == 255)


def hidden_city(flags: Column) -> Column:
    return has_any(flags, 0x01)


def mapped(code: Column, table: dict[int, int], default: int) -> Column:
    """A number for a code, by a short fixed table."""
    chosen = F
    for k, v in table.items():
        chosen = chosen.when(code == k, v)
    return chosen.otherwise(default)


def first_colour(flags: Column, choices: list[tuple[int, str]], default: str) -> Column:
    """The name of the first mask that the flags hold; later masks that an earlier one implies are never reached."""
    chosen = F
    for mask, name in choices:
        chosen = chosen.when(has_all(flags, mask), name)
    return chosen.otherwise(default)


def lane_count(own: Column, control: Column, other: Column) -> Column:
    """-2 means by context: the control node's count, else the other end's, else 1."""
    return F.when(own != -2, own).otherwise(F.coalesce(control, F.when(other != -2, other), F.lit(1)))
