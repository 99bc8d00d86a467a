"""Archives as a data source of Spark: planned by their indices, read by ranges of bytes.

The planner lists the archives of a folder and reads their indices only. A partition is a run of neighbouring entries of
an archive, so one of any size is many tasks, each of which reads the bytes of its own entries, and small ones share a task. Conditions on
``path`` (equal, in a list, begins with) are settled while planning: other entries' bytes are never read. Files are opened
by path, so the folder has to be one that the driver and all executors see.
"""

from __future__ import annotations

import fnmatch
import json
import os
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from cartolyte.sources import formats

SCHEMA = "archive string, archive_seq int, entry int, path string, at long, packed long, size long, kind int, content binary"
#: How an entry's bytes are kept (an own numbering): as they are, by zlib, or as a ZIP member behind its local header.
PLAIN, ZLIB, MEMBER = range(3)
#: Packed bytes of a partition, about, and what an archive counts for besides them, as it has to be opened.
SPLIT_BYTES, OPEN_BYTES = 64 << 20, 128 << 10


class Entry(NamedTuple):
    path: str
    at: int
    packed: int
    size: int
    kind: int


def local_path(path: str) -> str:
    """A path that Python can open."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"archives and files are opened by path, which {path} is not")
    return path


def _bytes_at(file: BinaryIO, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def read_entry(file: BinaryIO, entry) -> bytes:
    """The content of an entry, by one read, or two behind a local header."""
    if entry.kind != MEMBER:
        raw = _bytes_at(file, entry.at, entry.packed)
        return zlib.decompress(raw) if entry.kind == ZLIB else raw
    method, names, extra = struct.unpack("<8xH16xHH", _bytes_at(file, entry.at, 30))
    raw = _bytes_at(file, entry.at + 30 + names + extra, entry.packed)
    return raw if method == zipfile.ZIP_STORED else zlib.decompress(raw, -15)


def index_of(file: BinaryIO) -> Iterator[Entry]:
    """The entries of an archive. Of a hashed one the listings of folders are read too, as they alone have names."""
    head = _bytes_at(file, 0, 20)
    if head[:4] != formats.ARCHIVE_MAGIC:
        with zipfile.ZipFile(file) as z:
            yield from (Entry(i.filename, i.header_offset, i.compress_size, i.file_size, MEMBER) for i in z.infolist() if not i.is_dir())
        return
    version, _, method, count, start = struct.unpack_from("<HH4sii", head, 4)
    if version != 1 or method != formats.ARCHIVE_METHOD:
        raise formats.FormatError("unsupported archive version or hash method")
    known = {key: Entry("", at, packed, size, PLAIN if size == packed else ZLIB) for key, at, _, _, size, packed in struct.iter_unpack("<QqIIii", _bytes_at(file, start, 32 * count))}
    root = known.get(formats.path_hash(""))
    todo, seen = [""] if root is not None and root.size else list(formats.ROOTS), set()
    while todo:
        folder = todo.pop()
        listing = known.get(formats.path_hash(folder))
        if listing is None or folder in seen:
            continue
        seen.add(folder)
        for line in read_entry(file, listing).decode("utf-8", "replace").splitlines():
            name = f"{folder}/{line.lstrip('*')}".lstrip("/")
            if line.startswith("*"):
                todo.append(name)
            elif line and name not in seen and (found := known.get(formats.path_hash(name))) is not None:
                seen.add(name)
                yield found._replace(path=name)


class _Run(InputPartition):
    """Runs of neighbouring entries: (archive, its layer, numbered entries)."""

    def __init__(self, parts: list[tuple[str, int, list[tuple[int, Entry]]]]) -> None:
        super().__init__(None)
        self.parts = parts


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = local_path(options["path"])
        self.pattern = options.get("pattern", "*.scs")
        self.layers: dict[str, int] = json.loads(options.get("layers", "{}"))
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.with_content = options.get("content", "true").lower() == "true"
        self.conditions: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.conditions.append(("in", frozenset((f.value,))))
            elif isinstance(f, In) and f.attribute == ("path",):
                self.conditions.append(("in", frozenset(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.conditions.append(("prefix", f.value))
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        return all(path in v if kind == "in" else path.startswith(v) for kind, v in self.conditions)

    def partitions(self) -> list[_Run]:
        runs, parts, size = [], [], 0
        for name in sorted(os.listdir(self.folder)):
            if not fnmatch.fnmatch(name, self.pattern):
                continue
            archive = os.path.join(self.folder, name)
            with open(archive, "rb") as file:
                entries = [(i, e) for i, e in enumerate(index_of(file)) if self._wanted(e.path)]
            held = None
            for i, e in sorted(entries, key=lambda x: x[1].at):
                cost = (e.packed if self.with_content else 64) + (0 if held else OPEN_BYTES)
                if parts and size + cost > self.split:
                    runs.append(_Run(parts))
                    parts, size, held = [], 0, None
                if held is None:
                    held = []
                    parts.append((archive, self.layers.get(name, 0), held))
                held.append((i, e))
                size += cost
        if parts:
            runs.append(_Run(parts))
        return runs or [_Run([])]

    def read(self, partition: _Run) -> Iterator[tuple]:
        for archive, seq, entries in partition.parts:
            if not self.with_content:
                yield from ((archive, seq, i, *e, None) for i, e in entries)
                continue
            with open(archive, "rb") as file:
                for i, e in entries:
                    yield (archive, seq, i, *e, read_entry(file, e))


class ArchiveSource(DataSource):
    """``spark.read.format("cartolyte_archives")`` with the options path (a folder), pattern, layers (JSON of numbers by name), splitbytes and content."""

    @classmethod
    def name(cls) -> str:
        return "cartolyte_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def archives(spark: SparkSession, folder: str, layers: dict[str, int] | None = None, content: bool = True, **options: object) -> DataFrame:
    """The entries of all archives of a folder, with their content or without. Turns on the pushing of conditions into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(ArchiveSource.name()).options(layers=json.dumps(layers or {}), content=str(content).lower(), **{k: str(v) for k, v in options.items()}).load(folder)


def contents(entries: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """(archive_seq, path, content) of entries that were listed without: near ones of an archive are read in one task."""

    def run(frames):
        held, file = None, None
        try:
            for frame in frames:
                found = []
                for row in frame.itertuples():
                    if row.archive != held:
                        if file:
                            file.close()
                        held, file = row.archive, open(row.archive, "rb")
                    found.append(read_entry(file, row))
                yield pd.DataFrame({"archive_seq": frame["archive_seq"], "path": frame["path"], "content": found})
        finally:
            if file:
                file.close()

    near = entries.repartition("archive", F.floor(F.col("at") / split)).sortWithinPartitions("archive", "at")
    return near.select("archive", "archive_seq", "path", "at", "packed", "kind").mapInPandas(run, "archive_seq int, path string, content binary")


def layered_archives(spark: SparkSession, folder: str, layers: dict[str, int], where: Callable[[Column], Column] | None = None, **options: object) -> DataFrame:
    """(archive_seq, path, content): one row a path, that of the last layer, in a layer that of the last archive by name, in an archive the last entry.

    Winners are chosen among entries; only their bytes are read. ``where`` is a condition on paths.
    """
    entries = archives(spark, folder, layers, content=False, **options).drop("content")
    entries = entries.where(where(F.col("path"))) if where else entries
    last = entries.groupBy("path").agg(F.max_by(F.struct(*(c for c in entries.columns if c != "path")), F.struct("archive_seq", "archive", "entry")).alias("e"))
    return contents(last.select("path", "e.*"))
