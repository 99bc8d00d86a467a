"""String functions of definition files and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_printable(s: Column) -> Column:
    """Without the characters outside printable ASCII at both ends."""
    return F.regexp_replace(s, r"^[^!-~]+|[^!-~]+$", "")


def is_comment(line: Column) -> Column:
    return F.startswith(F.ltrim(line), F.lit("#"))


def line_key(line: Column) -> Column:
    """The key of a ``key: value`` line; null for comments and lines without a colon."""
    bare = trim_printable(line)
    valid = F.contains(bare, F.lit(":")) & ~F.startswith(bare, F.lit("#")) & ~F.startswith(bare, F.lit("//"))
    return F.when(valid, trim_printable(F.split_part(bare, F.lit(":"), F.lit(1))))


def line_value(line: Column) -> Column:
    """The part between the first and the second colon, cut at the last ``//``."""
    value = F.split_part(trim_printable(line), F.lit(":"), F.lit(2))
    return F.when(line_key(line).isNotNull(), trim_printable(F.regexp_replace(value, r"//(?!.*//).*$", "")))


def quoted(value: Column) -> Column:
    """What stands between the first two quotes; null without quotes."""
    return F.try_element_at(F.split(value, '"'), F.lit(2))


def dotted_part(value: Column, n: int) -> Column:
    """Part ``n`` (from 0) of a dotted id; null if there are fewer."""
    return F.try_element_at(F.split(value, r"\."), F.lit(n + 1))


def vector_part(value: Column, n: int) -> Column:
    """Component ``n`` (from 0) of ``(x, y, z)`` as FLOAT; bad numbers raise."""
    parts = F.split(F.regexp_extract(value, r"\(([^)]*)\)", 1), ",")
    return F.trim(F.try_element_at(parts, F.lit(n + 1))).cast("float")


def safe_int(value: Column) -> Column:
    """An integer, or null if the text is none."""
    return F.trim(value).try_cast("int")


def combine_path(first: Column, second: Column) -> Column:
    """Two path parts with forward slashes and no leading slash; an absolute second part replaces the first."""
    slashed = F.regexp_replace(second, r"\\", "/")
    joined = F.when(F.startswith(slashed, F.lit("/")) | (first == ""), slashed).otherwise(F.concat(F.regexp_replace(F.regexp_replace(first, r"\\", "/"), "/$", ""), F.lit("/"), slashed))
    return F.regexp_replace(joined, "^/", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.when(F.contains(file_name(path), F.lit(".")), F.substring_index(file_name(path), ".", -1)).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.split_part(file_name(path), F.lit("."), F.lit(1))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def localised(names: Column, locale: str, fallback: Column) -> Column:
    """The name in a locale, else the fallback; also for a missing map."""
    return F.coalesce(F.try_element_at(names, F.lit(locale)), fallback)


def rgb_hex(red: Column, green: Column, blue: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.hex(c), 2, "0") for c in (red, green, blue)))
