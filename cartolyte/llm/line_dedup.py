"""Line dedup by range-partitioned hashes, with DataFrame operations only.

A line's key is the line without white space at both ends and with A-Z lower-cased. Its occurrences, as 128 bits of
SHA-256 with document and position and without any text, are partitioned by ranges of (hash, document) and sorted by
(hash, document, position) inside. Each range is then streamed: the first occurrence of a key in a document counts for
the key, and the counts of a range are formed before they move on. Keys in enough documents lose their lines everywhere
but in the largest document that holds them. What comes back for a document is no text but its keep bitmap, run-length
compressed: the lengths of alternating runs of kept and dropped lines.

Skew: a range is of hashes *and* documents, so a line that a third of all documents hold is spread over many ranges and
leaves each as one row. The frequent keys meet the occurrences again, and the bitmaps the texts, by plain exchanges, which
Spark splits where they are skewed, or broadcasts where the files of one side are small. Texts are cut once for the
occurrences, which are written, and once to apply the bitmaps.

Defined cases: a null or empty text is one empty line; a key with fewer than ``least_chars`` code points is never
dropped; repeated rows of one doc_id count as one document and each give a row; null ids count as one document, the
smallest; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolyte.llm.common import drop_written, text_or_empty, written

#: Code points that a key has to have, and documents that have to hold it, for its lines to go.
LEAST_CHARS, LEAST_DOCS = 20, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), _UPPER, _LOWER)


def key_hash(key: Column) -> Column:
    """Half of a SHA-256 digest, as 16 bytes."""
    return F.unhex(F.left(F.sha2(F.encode(key, "UTF-8"), 256), F.lit(32)))


def _same_text(text: Column) -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(text)


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, doc_id, version, pos): the lines with long enough keys, by the hash of their key."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = base.select("doc_id", _same_text(F.col("text")).alias("version"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.select("doc_id", "version", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return rows.select(key_hash(F.col("key")).alias("h"), "doc_id", "version", "pos")


def frequent_keys(found: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h, last_id, n_docs) of the keys in at least so many documents."""
    ranged = found.select("h", "doc_id", "version", "pos").repartitionByRange("h", "doc_id").sortWithinPartitions("h", "doc_id", "pos")
    # The window and the sums by (h, doc_id) take the ranges and their order as they are: rows stream by, none moves.
    first = F.row_number().over(Window.partitionBy("h", "doc_id").orderBy("pos"))
    firsts = ranged.withColumn("_nth", first).where("_nth = 1")
    return firsts.groupBy("h").agg(F.max("doc_id").alias("last_id"), F.count("*").alias("n_docs")).where(F.col("n_docs") >= least_docs)


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, starts, ends) of the documents that lose lines: the runs of dropped lines; ``version`` is the text's hash."""
    found = written(occurrences(docs, least_chars, id_col, text_col), "lines")
    keys = written(frequent_keys(found, least_docs), "keys")
    gone = found.join(keys.select("h", "last_id"), "h").where(~F.col("doc_id").eqNullSafe(F.col("last_id")))
    sets = gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    at = F.col("dropped")
    starts = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) < x - 1))
    lasts = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > x + 1))
    out = written(sets.select("doc_id", "version", starts.alias("starts"), F.transform(lasts, lambda x: x + 1).alias("ends")), "bitmaps")
    for table in (found, keys):
        drop_written(table)
    return out


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, keep_runs, kept (the text of the lines that stay).

    ``keep_runs`` are the lengths of runs of kept, dropped, kept ... lines; the first may be 0, the last is of kept lines.
    """
    bitmaps = keep_bitmaps(docs, least_chars, least_docs, id_col, text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("version", _same_text(F.col("text")))
    # The bitmaps are the small side: hashed, they spare a sort of the texts.
    gone = bitmaps.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "starts", "ends").hint("shuffle_hash")
    held = base.join(gone, base["doc_id"].eqNullSafe(gone["_id"]) & (base["version"] == gone["_version"]), "left")
    rows = held.select("doc_id", "text", "starts", "ends", lines_of(F.col("text")).alias("lines"))
    starts, ends, lines, n = F.col("starts"), F.col("ends"), F.col("lines"), F.size("lines")
    whole = starts.isNull()
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
    runs = F.concat(F.flatten(F.transform(starts, lambda s, i: F.array(s - begin(i), F.get(ends, i) - s))), F.array(n - F.element_at(ends, -1)))
    # The kept run before each dropped one, and the one after the last.
    kept = F.flatten(F.transform(F.concat(starts, F.array(n)), lambda s, i: F.slice(lines, begin(i) + 1, s - begin(i))))
    dropped = F.aggregate(F.zip_with(starts, ends, lambda s, e: e - s), F.lit(0), lambda a, x: a + x)
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_lines"),
        F.when(whole, F.lit(0)).otherwise(dropped).cast("long").alias("n_dropped"),
        F.when(whole, F.array(n)).otherwise(runs).alias("keep_runs"),
        F.when(whole, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, keep_runs."""
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"), "keep_runs")
