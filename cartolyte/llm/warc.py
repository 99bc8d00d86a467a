"""WARC captures: not-modified revisits resolved to the full response that they confirm.

A revisit (status 304) holds no body. It stands for the latest earlier full response of its canonical URL, provided the
validators agree: entity tags by weak comparison where both have one, else the modification dates. The resolved record
takes the response's body reference and headers, updated by the revisit's headers but for those that describe the body
(RFC 9111, section 3.2).

The as-of join is made of windows, with no inequality join: within a URL's block of time the last response before each
record, and across blocks the last response of an earlier block, for which one row per block is enough. A URL with a
third of all captures is thereby spread over its blocks. Bodies don't take part; a record carries a digest instead.

Reading files. Spark hands a WARC file to one task, whole, as its members can't be told apart from outside (2 GB at most, which
is twice the usual size); there it is unpacked and parsed as a stream, and rows leave in batches of ``BATCH_BYTES``.
Members that are damaged or cut off end their file; what came before them is kept, a record shorter than it says is not.

Defined cases: a record with a null URL or date resolves to nothing, and is nothing that others resolve to; of responses of the same time the greater record
id is later; a revisit without validators, or whose response has none to compare, is not resolved; repeated records
are resolved each; null headers count as none; an empty table gives an empty result; other columns are kept, but for those
with the name of a result (canonical, resolution, target_id, payload, merged_headers), which it replaces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from io import BufferedReader, BytesIO, RawIOBase

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolyte.llm.common import free_names

#: Headers that describe the stored body, which a 304 doesn't change (fixed values).
BODY_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "connection")
SCHEMA = "record_id string, url string, warc_date timestamp, warc_type string, status int, headers map<string,string>, body binary"


def canonical_url(url: Column) -> Column:
    """Without scheme, www, default port, fragment and trailing slash; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.|:(80|443)$", "")
    return F.regexp_replace(F.concat(host, F.regexp_replace(bare, r"^[^/?]*", "")), r"/+$", "")


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def resolve_revisits(records: DataFrame, block: str = "hour") -> DataFrame:
    """The records with canonical, resolution, target_id, payload and merged_headers.

    ``records`` has record_id, url, warc_date, is_revisit, headers (map, lower-case names) and payload (a body
    reference). ``resolution`` is response, resolved, mismatch or missing.
    """
    part, near, far, found = free_names(records, "_block", "_near", "_far", "_found")
    every = records.withColumn("canonical", canonical_url(F.col("url")))
    placed = F.col("canonical").isNotNull() & F.col("warc_date").isNotNull()
    at = every.where(placed).withColumn(part, F.date_trunc(block, "warc_date"))
    content = F.struct("record_id", "headers", "payload")
    in_block = Window.partitionBy("canonical", part).orderBy("warc_date", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn(near, F.last(F.when(~F.col("is_revisit"), content), ignorenulls=True).over(in_block))
    ends = at.where("NOT is_revisit").groupBy("canonical", part).agg(F.max_by(content, F.struct("warc_date", "record_id")).alias("last"))
    blocks = at.where("is_revisit").select("canonical", part).distinct().join(ends, ["canonical", part], "full")
    before = Window.partitionBy("canonical").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("canonical", part, F.last("last", ignorenulls=True).over(before).alias(far))
    at = at.join(carried, ["canonical", part], "left").withColumn(found, F.coalesce(near, far)).drop(part, near, far)
    at = at.unionByName(every.where(~placed), allowMissingColumns=True)

    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    full = F.coalesce(F.col(found)["headers"], F.create_map().cast("map<string,string>"))
    tags = _tag(own["etag"]) == _tag(full["etag"])
    dates = own["last-modified"] == full["last-modified"]
    agrees = F.coalesce(tags, dates, F.lit(False))
    resolution = F.when(~F.col("is_revisit"), "response").when(F.col(found).isNull(), "missing").when(agrees, "resolved").otherwise("mismatch")
    permitted = F.map_filter(own, lambda k, v: ~k.isin(*BODY_HEADERS))
    kept = F.map_filter(full, lambda k, v: ~F.map_contains_key(permitted, k))
    done = F.col("resolution") == "resolved"
    return (
        at.withColumn("resolution", resolution)
        .withColumn("target_id", F.when(done, F.col(found)["record_id"]))
        .withColumn("payload", F.when(done, F.col(found)["payload"]).when(~F.col("is_revisit"), F.col("payload")))
        .withColumn("merged_headers", F.when(done, F.map_concat(kept, permitted)).otherwise(F.col("headers")))
        .drop(found)
    )


def header_lines(headers: Column) -> Column:
    """Headers as sorted lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")


#: Bodies of a batch of rows, at least, in bytes.
BATCH_BYTES = 8_000_000


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, sep, v in pairs if sep}


def _number(text: str | bytes | None) -> int | None:
    return int(text) if text and text.isdigit() and len(text) < 19 else None


def _record(stream: BufferedReader) -> tuple | None:
    """The record that starts behind a version line; None if it is of another kind or cut off."""
    head = []
    while (line := stream.readline()).strip():
        head.append(line)
    warc = _fields(head)
    size = _number(warc.get("content-length")) or 0
    content = stream.read(size)
    if warc.get("warc-type") not in ("response", "revisit") or len(content) < size:
        return None
    top, _, body = content.partition(b"\r\n\r\n")
    first, *rest = top.split(b"\r\n")
    date = pd.to_datetime(warc.get("warc-date"), utc=True, errors="coerce")
    status = first.split()[1:2]
    return warc.get("warc-record-id"), warc.get("warc-target-uri"), None if pd.isna(date) else date.tz_convert(None), warc["warc-type"], _number(status[0]) if status else None, _fields(rest), body


class _Unzipped(RawIOBase):
    """The members of a gzip file one after the other, as far as they are whole."""

    def __init__(self, data: bytes):
        self.data, self.at, self.member = data, 0, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        out = b""
        while not out:
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                self.member = zlib.decompressobj(31)
            piece = self.member.unconsumed_tail
            if not piece:
                piece = self.data[self.at : self.at + 65_536]
                self.at += len(piece)
            if not piece:
                break
            try:
                out = self.member.decompress(piece, len(buffer))
            except zlib.error:
                self.at = len(self.data)
                break
        buffer[: len(out)] = out
        return len(out)


def parse_warc(data: bytes) -> Iterator[tuple]:
    """The responses and revisits of a WARC file, plain or gzipped per record, as rows of :data:`SCHEMA`."""
    stream = BufferedReader(_Unzipped(data) if data[:2] == b"\x1f\x8b" else BytesIO(data))
    while line := stream.readline():
        if line.startswith(b"WARC/") and (record := _record(stream)):
            yield record


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of the WARC files under ``path``; a file is one task's work."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                rows, held = [], 0
                for record in parse_warc(content):
                    rows.append(record)
                    held += len(record[-1])
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)
