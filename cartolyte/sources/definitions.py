"""Definition tables from definition text: cities, countries, prefabs, road looks, ferry connections, with localised names.

Each function takes the layered file table (path, content) and returns a row for each definition, keyed by ``token``; of
repeated tokens the first loaded counts, in the order of paths and lines, and token 0 never does. Within a definition the
last line of a key counts, lists are in line order. A block that lacks what its kind needs is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolyte.functions import strings
from cartolyte.functions.tokens import token
from cartolyte.operators import precedence
from cartolyte.sources.tables import expand_includes, key_values, lines

#: Offsets of a city's label by zoom: a list holds four for another purpose before them (fixed value).
SKIPPED_OFFSETS = 4
#: Ferry points are stored in units of 1/256 (fixed value).
FERRY_UNIT = 256


def _in(folder: str, part: str, first: str = "") -> Column:
    """Files of a folder whose name holds ``part`` and starts with ``first``."""
    name = strings.file_name(F.col("path"))
    return (strings.directory(F.col("path")) == folder) & F.contains(name, F.lit(part)) & F.startswith(name, F.lit(first))


def _last(key: str, value: Column, order: str) -> Column:
    """The value of the last line of a key."""
    return F.max_by(F.when(F.col("key") == key, value), F.when((F.col("key") == key) & value.isNotNull(), F.col(order)))


def _listed(held: Column, value: Column, order: str) -> Column:
    """The values of all lines that meet a condition, in line order."""
    return F.transform(F.array_sort(F.collect_list(F.when(held, F.struct(F.col(order).alias("at"), value.alias("v"))))), lambda x: x["v"])


def _included(files: DataFrame, part: str) -> DataFrame:
    """The valid lines of the files that those of ``def`` include; each include is a definition of its own."""
    text = expand_includes(files, _in("def", part)).where("target IS NOT NULL").drop("target")
    return key_values(text, ["path", "line_no"], ["inner_no"])


def _blocks(files: DataFrame, chosen: Column) -> DataFrame:
    return key_values(lines(files.where(chosen)), ["path"], ["line_no"])


def _first(definitions: DataFrame, keys: list[str]) -> DataFrame:
    return precedence.first_wins(definitions.where("token <> 0"), keys, "load_seq")


def _loc_token(key: str, order: str) -> Column:
    return F.replace(_last(key, strings.quoted(F.col("value")), order), F.lit("@"), F.lit("")).alias("loc_token")


def _offsets(axis: str) -> Column:
    listed = _listed(F.contains(F.col("key"), F.lit(f"map_{axis}_offsets[]")), F.col("value"), "inner_no")
    kept = F.transform(F.slice(listed, SKIPPED_OFFSETS + 1, 1 << 30), strings.safe_int)
    return F.filter(kept, lambda x: x.isNotNull()).alias(f"{axis}_offsets")


def cities(files: DataFrame) -> DataFrame:
    """(token, name, loc_token, country, x_offsets, y_offsets, load_seq)."""
    rows = _included(files, "city").groupBy("path", "line_no").agg(
        token(strings.trim_printable(strings.dotted_part(_last("city_data", F.col("value"), "inner_no"), 1))).alias("token"),
        _last("city_name", strings.quoted(F.col("line")), "inner_no").alias("name"),
        _loc_token("city_name_localized", "inner_no"),
        _last("country", F.col("value"), "inner_no").alias("country"),
        _offsets("x"),
        _offsets("y"),
    )
    return _first(rows.withColumn("load_seq", F.struct("path", "line_no")).drop("path", "line_no"), ["token"])


def countries(files: DataFrame) -> DataFrame:
    """(token, country_id, name, loc_token, country_code, x, y, load_seq)."""
    at = _last("pos", F.col("value"), "inner_no")
    rows = _included(files, "country").groupBy("path", "line_no").agg(
        token(strings.trim_printable(strings.dotted_part(_last("country_data", F.col("value"), "inner_no"), 2))).alias("token"),
        _last("country_id", F.col("value"), "inner_no").cast("int").alias("country_id"),
        _last("name", strings.quoted(F.col("value")), "inner_no").alias("name"),
        _loc_token("name_localized", "inner_no"),
        _last("country_code", strings.quoted(F.col("value")), "inner_no").alias("country_code"),
        strings.vector_part(at, 0).alias("x"),
        strings.vector_part(at, 2).alias("y"),
    )
    return _first(rows.withColumn("load_seq", F.struct("path", "line_no")).drop("path", "line_no"), ["token"])


def prefabs(files: DataFrame) -> DataFrame:
    """(token, path, category, load_seq): the descriptor's path of each prefab."""
    rows = _blocks(files, _in("def/world", "prefab", "prefab")).groupBy("path", "block").agg(
        token(strings.trim_printable(strings.dotted_part(_last("prefab_model", F.col("value"), "line_no"), 1))).alias("token"),
        strings.combine_path(F.lit(""), _last("prefab_desc", strings.quoted(F.col("value")), "line_no")).alias("descriptor"),
        F.coalesce(_last("category", strings.quoted(F.col("value")), "line_no"), F.lit("")).alias("category"),
    )
    held = rows.where("descriptor <> ''").select("token", F.col("descriptor").alias("path"), "category", F.struct("path", "block").alias("load_seq"))
    return _first(held, ["token"])


def road_looks(files: DataFrame) -> DataFrame:
    """(token, offset, lanes_left, lanes_right, load_seq)."""
    rows = _blocks(files, _in("def/world", "road_look", "road")).groupBy("path", "block").agg(
        token(strings.trim_printable(F.replace(strings.dotted_part(_last("road_look", F.col("value"), "line_no"), 1), F.lit("{"), F.lit("")))).alias("token"),
        F.coalesce(_last("road_offset", F.col("value"), "line_no").cast("float"), F.lit(0.0).cast("float")).alias("offset"),
        _listed(F.col("key") == "lanes_left[]", F.col("value"), "line_no").alias("lanes_left"),
        _listed(F.col("key") == "lanes_right[]", F.col("value"), "line_no").alias("lanes_right"),
    )
    return _first(rows.withColumn("load_seq", F.struct("path", "block")).drop("path", "block"), ["token"])


def ferry_connections(files: DataFrame) -> DataFrame:
    """(start_token, end_token, points, load_seq): points as (x, z, rot) in the order of their numbers; of a pair of ports, in either order, the first connection."""
    number = F.regexp_extract(F.col("key"), r"\[(\d+)\]", 1).try_cast("int")
    part = lambda n: strings.vector_part(F.col("value"), n)
    placed, headed = F.contains(F.col("key"), F.lit("connection_positions")), F.contains(F.col("key"), F.lit("connection_directions"))
    unit = F.lit(float(FERRY_UNIT))
    at = F.struct(number.alias("n"), (part(0) / unit).cast("float").alias("x"), (part(2) / unit).cast("float").alias("z"))
    turn = F.struct(number.alias("n"), F.atan2(part(2), part(0)).alias("rot"))
    ids = _last("ferry_connection", F.col("value"), "line_no")
    rows = _blocks(files, _in("def/ferry/connection", "sii")).groupBy("path", "block").agg(
        token(strings.dotted_part(ids, 1)).alias("start_token"),
        token(F.trim(F.rtrim(strings.dotted_part(ids, 2), F.lit("{")))).alias("end_token"),
        F.array_sort(F.collect_list(F.when(placed, at))).alias("at"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.when(headed & number.isNotNull(), turn)))).alias("turns"),
    )
    point = lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z"), F.coalesce(F.try_element_at("turns", p["n"]), F.lit(0.0)).alias("rot"))
    held = rows.where("start_token IS NOT NULL").select("start_token", "end_token", F.transform("at", point).alias("points"), F.struct("path", "block").alias("load_seq"))
    return precedence.one_per_pair(held, "start_token", "end_token", "load_seq").drop("lo", "hi")


def with_names(definitions: DataFrame, names: DataFrame, first_only: bool = False) -> DataFrame:
    """Definitions with ``localized_names`` (locale -> name) of their key; null where there are none.

    With ``first_only`` only the first definition of a key gets them, as countries do; cities all get them.
    """
    maps = names.where("key <> '' AND name <> ''").groupBy(F.col("key").alias("loc_token")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("locale", "name")))).alias("localized_names"))
    if not first_only:
        return definitions.join(maps, "loc_token", "left")
    first = definitions.groupBy("loc_token").agg(F.min("load_seq").alias("first_seq"))
    maps = first.join(maps, "loc_token").select(F.col("loc_token").alias("_key"), "first_seq", "localized_names")
    return definitions.join(maps, (F.col("loc_token") == F.col("_key")) & (F.col("load_seq") == F.col("first_seq")), "left").drop("_key", "first_seq")
