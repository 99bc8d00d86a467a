"""Spark tables from files: archives to a layered file table, sectors, prefabs, textures, locales and definition text.

A file is the unit of work, as none of the formats can be split; tasks decode the files of their partition and Spark
spreads those. Decode once, write Parquet, query that.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolyte.functions import strings
from cartolyte.functions.tokens import token
from cartolyte.operators import precedence, runs, scans
from cartolyte.schemas import FILES, ITEMS, NODES, PREFABS, TEXTURES
from cartolyte.sources import formats
from cartolyte.sources.shared import written


#: Unpacked bytes and rows that leave a task at once, about; larger files are alone.
FRAME_BYTES, FRAME_ROWS = 32_000_000, 10_000


def archive_files(spark: SparkSession, folder: str, layers: dict[str, int], pattern: str = "*.scs") -> DataFrame:
    """(archive_seq, archive, entry, path, content) of all files of the archives in a folder; ``layers`` gives the layer of an archive's name, 0 if absent.

    Archives are read whole; :mod:`cartolyte.sources.archives` reads them by ranges, and winners' contents only.
    """
    return unpacked(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder), layers)


def entry_frames(frames: Iterator[pd.DataFrame], layers: dict[str, int]) -> Iterator[pd.DataFrame]:
    """The files of archives by frames. Small archives share one: a frame for each would cost many times what its files do."""
    columns, rows, held = [c.split()[0] for c in FILES.split(", ")], [], 0
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            seq = layers.get(path.rsplit("/", 1)[-1], 0)
            for i, entry in enumerate(formats.archive_entries(content)):
                rows.append((seq, path, i, *entry))
                held += len(entry[1])
                if held >= FRAME_BYTES or len(rows) >= FRAME_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def unpacked(archives: DataFrame, layers: dict[str, int]) -> DataFrame:
    """The same of archives (path, content) that are rows already."""
    return archives.select("path", "content").mapInPandas(lambda frames: entry_frames(frames, layers), FILES)


def layered(files: DataFrame) -> DataFrame:
    """One row a path: that of the last layer, in a layer that of the last archive by name, in an archive the last entry.

    Files are written once, as both the choice of winners, on paths alone, and the move of contents to their winner read them.
    """
    files, place = written(files, "files"), ["archive_seq", "archive", "entry"]
    last = files.groupBy("path").agg(F.max(F.struct(*place)).alias("_last")).select("path", "_last.*")
    return files.join(last, ["path", *place], "left_semi").dropDuplicates(["path", *place]).select("archive_seq", "path", "content")


def map_sectors(files: DataFrame) -> DataFrame:
    """The sector files of all maps that have an index file, with the map's name."""
    maps = files.where(strings.extension(F.col("path")) == "mbd").select(strings.stem(F.col("path")).alias("map")).distinct()
    sectors = files.where(strings.extension(F.col("path")) == "base").withColumn("map", strings.file_name(strings.directory(F.col("path"))))
    return sectors.where(F.col("path") == F.concat(F.lit("map/"), "map", F.lit("/"), strings.file_name(F.col("path")))).join(maps, "map", "left_semi")


def _in_order(files: DataFrame) -> DataFrame:
    """Files with ``file_ord``, their rank by path: the high bits of the load order."""
    ranked = scans.total_places(files.select("path").distinct(), ["path"], "file_ord")
    return files.join(ranked.withColumn("file_ord", F.col("file_ord") - 1), "path")


#: Token of ``parking_ico``, which overlays of the parking kind have if they name none (fixed value).
PARKING = 159190000071683284


def sector_items(files: DataFrame, game: str = "ets2", types: frozenset[str] = formats.KEPT, strict: bool = True) -> DataFrame:
    """The items of sector files; the asked types are pushed down into the decoder."""
    return _in_order(files).select("content", "file_ord").mapInPandas(lambda frames: item_frames(frames, game, types, strict), ITEMS)


def _cut(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of ``FRAME_ROWS``, whatever files they come from: a batch of files has many times the rows that a task should hold."""
    while held := list(itertools.islice(rows, FRAME_ROWS)):
        # As objects: among nulls, pandas would turn 64-bit keys into floating point.
        yield pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in zip(columns, zip(*held))})


def item_frames(frames: Iterator[pd.DataFrame], game: str, types: frozenset[str], strict: bool) -> Iterator[pd.DataFrame]:
    """The items of sector files (content, file_ord) by frames."""
    names = [c.split()[0] for c in ITEMS.split(", ")]

    def rows():
        for frame in frames:
            for content, order in zip(frame["content"], frame["file_ord"]):
                for i, (kind, item) in enumerate(formats.read_sector(content, game, types, strict)[0]):
                    if kind == "overlay" and item["flags"][2] == 1 and item["look"] == 0:
                        item["look"] = PARKING
                    row = item | {"load_seq": (int(order) << 32) | i, "look_token": item.get("look"), "start_uid": item.get("start"), "end_uid": item.get("end"), "node_uid": item.get("node"), "prefab_uid": item.get("prefab"), "color_index": item.get("color")}
                    row |= {"zoom_visibility": item["flags"][0] if kind == "overlay" else None, "is_train": bool(item["flags"][0]) if kind == "ferry" else None, "draw_over": bool(item["flags"][0]) if kind == "map_area" else None}
                    yield tuple(row.get(n) for n in names)

    return _cut(rows(), names)


def node_frames(frames: Iterator[pd.DataFrame], strict: bool) -> Iterator[pd.DataFrame]:
    """The nodes of sector files (content, file_ord) by frames."""
    rows = (((int(o) << 32) | i, n["uid"], n["x"], n["z"], n["rotation"]) for frame in frames for c, o in zip(frame["content"], frame["file_ord"]) for i, n in enumerate(formats.read_sector(c, types=frozenset(), strict=strict)[1]))
    return _cut(rows, ["load_seq", "uid", "x", "z", "rotation"])


def sector_nodes(files: DataFrame, strict: bool = True) -> DataFrame:
    """The nodes of sector files, each uid once: the first loaded."""
    nodes = _in_order(files).select("content", "file_ord").mapInPandas(lambda frames: node_frames(frames, strict), NODES)
    return precedence.first_wins(nodes, ["uid"], "load_seq")


def prefabs(files: DataFrame) -> DataFrame:
    def run(frames):
        for frame in frames:
            rows = [{"path": p} | formats.read_prefab(c) for p, c in zip(frame["path"], frame["content"])]
            yield pd.DataFrame(rows, columns=["path", "valid_road", "nodes", "spawn_points", "map_points", "trigger_points"])

    return files.select("path", "content").mapInPandas(run, PREFABS)


def textures(files: DataFrame) -> DataFrame:
    def run(frames):
        for frame in frames:
            rows = [(p, *formats.read_texture(c)) for p, c in zip(frame["path"], frame["content"])]
            yield pd.DataFrame(rows, columns=["path", "width", "height", "bgra"])

    return files.select("path", "content").mapInPandas(run, TEXTURES)


def _text(content: Column) -> Column:
    """Bytes as UTF-8, with U+FFFD for what is none."""
    return F.make_valid_utf8(content.cast("string"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of text files."""
    return files.select("path", F.posexplode(F.split(_text(F.col("content")), "\n")).alias("line_no", "line"))


def expand_includes(files: DataFrame, pattern: Column, base: str = "def") -> DataFrame:
    """Lines of the files that meet a condition, with each ``@include`` replaced by the named file's lines, and its path as ``target``."""
    own = lines(files.where(pattern))
    named = F.when(F.startswith(F.ltrim("line"), F.lit("@include")), strings.combine_path(F.lit(base), strings.quoted(F.col("line"))))
    own = own.withColumn("target", named)
    named_files = files.join(own.where("target IS NOT NULL").select(F.col("target").alias("path")).distinct(), "path", "left_semi")
    inner = lines(named_files).select(F.col("path").alias("target"), F.col("line_no").alias("inner_no"), F.col("line").alias("inner"))
    return own.join(inner, "target", "left").select("path", "line_no", F.coalesce("inner_no", F.lit(0)).alias("inner_no"), F.coalesce("inner", "line").alias("line"), "target")


def key_values(text: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Valid ``key: value`` rows with the number of the block they are in; a line with ``}`` ends one."""
    blocks = runs.with_block(text, keys, order, F.contains("line", F.lit("}")))
    rows = blocks.withColumn("key", strings.line_key(F.col("line"))).withColumn("value", strings.line_value(F.col("line")))
    return rows.where(~strings.is_comment(F.col("line")) & F.col("key").isNotNull())


def locale_names(files: DataFrame) -> DataFrame:
    """(locale, key, name): pairs of ``key[]`` and ``val[]`` lines; the last key holds for each value; the first name counts."""
    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "text": [formats.reveal(c) for c in frame["content"]]})

    plain = files.where(F.startswith("path", F.lit("locale/"))).select("path", "content").mapInPandas(run, "path string, text string")
    text = plain.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = text.withColumn("locale", F.split_part("path", F.lit("/"), F.lit(2))).withColumn("k", strings.line_key(F.col("line"))).withColumn("v", strings.quoted(strings.line_value(F.col("line"))))
    held = runs.carried(rows, ["path"], ["line_no"], F.when(F.col("k") == "key[]", F.col("v")), "key")
    names = held.where("k = 'val[]' AND key IS NOT NULL").select("locale", "key", F.col("v").alias("name"), F.struct("path", "line_no").alias("load_seq"))
    return precedence.first_wins(names, ["locale", "key"], "load_seq").drop("load_seq")


def overlay_bitmaps(files: DataFrame) -> DataFrame:
    """(token, name, width, height, bgra) of the overlays whose texture is there."""
    wanted = overlay_catalogue(files).select("name", F.col("texture").alias("path"))
    held = files.join(wanted.select("path").distinct(), "path", "left_semi")
    return textures(held).join(wanted, "path").select(token(F.col("name")).alias("token"), "name", "width", "height", "bgra")


def overlay_catalogue(files: DataFrame) -> DataFrame:
    """(name, material, texture): overlay materials and the texture at the end of their pointer chain; the first of a name counts."""
    path, name = F.col("path"), strings.stem(F.col("path"))
    folder = strings.directory(path)
    chosen = files.where((strings.extension(path) == "mat") & (((folder == "material/ui/map") & ~F.startswith(name, F.lit("map"))) | (folder == "material/ui/company/small") | (folder == "material/ui/map/road")))
    materials = lines(chosen).where(F.startswith(strings.line_key(F.col("line")), F.lit("texture")))
    named = F.when(folder == "material/ui/map/road", F.regexp_replace(name, "^road_", "")).otherwise(name)
    rank = F.when(folder == "material/ui/map", 0).when(folder == "material/ui/company/small", 1).otherwise(2)
    rows = materials.select(named.alias("name"), path.alias("material"), strings.combine_path(folder, strings.quoted(strings.line_value(F.col("line")))).alias("pointer"), F.struct(rank, "path", "line_no").alias("load_seq"))
    targets = _text(F.substring("content", 0x31, 1 << 20))
    pointers = files.where(strings.extension(path) == "tobj").select(path.alias("pointer"), F.regexp_replace(targets, "^/", "").alias("texture"))
    return precedence.first_wins(rows.join(pointers, "pointer"), ["name"], "load_seq").select("name", "material", "texture")
