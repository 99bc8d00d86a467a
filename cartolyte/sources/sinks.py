"""Sinks with commit: one JSON array file from ordered parts, and named files, both whole or not at all.

Tasks write below a hidden folder beside the target, each into a folder of its own. Only what committed tasks wrote is
moved into place; what failed or repeated tasks left goes with that folder. Files are opened by path, so the target has to
be one that the driver and all executors see.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from cartolyte.sources.archives import local_path


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


class _Staged(DataSourceWriter):
    """What both writers share: a staging folder beside the target, which goes in the end in any case."""

    def __init__(self, options: dict[str, str]) -> None:
        self.target = local_path(options["path"]).rstrip("/")
        self.staging = os.path.join(os.path.dirname(self.target), f".{os.path.basename(self.target)}-{uuid.uuid4().hex}")
        os.makedirs(self.staging)

    def own_folder(self) -> tuple[int, str]:
        # The driver made the staging folder. Where it is gone, the job has ended, and a task that goes on may not bring it back.
        folder = os.path.join(self.staging, uuid.uuid4().hex)
        os.mkdir(folder)
        return TaskContext.get().partitionId(), folder

    def abort(self, messages) -> None:
        for _ in range(50):  # tasks that weren't told yet may write meanwhile
            shutil.rmtree(self.staging, ignore_errors=True)
            if not os.path.exists(self.staging):
                return
            time.sleep(0.1)


class JsonArrayWriter(_Staged):
    def write(self, iterator: Iterator[Row]) -> Part:
        number, folder = self.own_folder()
        path, rows = os.path.join(folder, "part"), 0
        with open(path, "w", encoding="utf-8") as out:
            for row in iterator:
                out.write(",\n" if rows else "")
                out.write(row[0])
                rows += 1
        return Part(number, path, rows)

    def commit(self, messages) -> None:
        try:
            whole = os.path.join(self.staging, "whole")
            with open(whole, "wb") as out:
                out.write(b"[")
                parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)
                for i, part in enumerate(parts):
                    out.write(b",\n" if i else b"\n")
                    with open(part.path, "rb") as rows:
                        shutil.copyfileobj(rows, out, 1 << 20)
                out.write(b"\n]\n")
            os.replace(whole, self.target)
        finally:
            self.abort(messages)


class FilesWriter(_Staged):
    def write(self, iterator: Iterator[Row]) -> Part:
        number, folder = self.own_folder()
        rows = 0
        for name, content in iterator:
            path = os.path.normpath(os.path.join(folder, name))
            if not path.startswith(folder + os.sep) or os.path.exists(path):
                raise ValueError(f"{name} is no name of a file below the folder, or comes twice")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as out:
                out.write(content)
            rows += 1
        return Part(number, folder, rows)

    def commit(self, messages) -> None:
        try:
            moves = [(os.path.join(at, name), os.path.relpath(os.path.join(at, name), m.path)) for m in messages if m is not None for at, _, names in os.walk(m.path) for name in names]
            if len({name for _, name in moves}) < len(moves):
                raise ValueError("several rows name one file")
            os.makedirs(self.target, exist_ok=True)
            for staged, name in moves:
                path = os.path.join(self.target, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                os.replace(staged, path)
        finally:
            self.abort(messages)


class JsonArraySink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cartolyte_json_array"

    def writer(self, schema, overwrite: bool) -> JsonArrayWriter:
        return JsonArrayWriter(dict(self.options))


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cartolyte_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(dict(self.options))


def write_json_array(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """The rows as one file with a JSON array, in the order of some columns if these are given; nulls are left out, as Spark's JSON does.

    Rows are sorted in ranges, each of which a task writes; the driver puts the files of these together.
    """
    rows.sparkSession.dataSource.register(JsonArraySink)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    ranged.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.format(JsonArraySink.name()).mode("append").save(path)


def write_files(files: DataFrame, folder: str) -> None:
    """Each row (name, content) as a file of a folder. Files that are there are replaced, one by one; a name that comes twice fails the whole."""
    files.sparkSession.dataSource.register(FilesSink)
    files.select("name", "content").write.format(FilesSink.name()).mode("append").save(folder)
