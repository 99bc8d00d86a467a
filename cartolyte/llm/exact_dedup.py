"""Exact dedup by content-defined chunk recipes, with DataFrame operations only.

Each normalised text is cut into chunks where its own content says so (sentence ends, within length bounds), so equal
texts give equal chunk lists. A chunk's identifier is its 64-bit hash, verified: the distinct (hash, chunk) rows are
formed once, with map-side combining, and a hash that stands for several chunks gets their rank as a second part. Two
documents are equal exactly if their ordered identifier lists are, so documents are grouped by these short lists and no
long text is moved to find its group.

Skew: the chunk rows and the groups are combined map-side before they are shuffled. The groups of two or more are written
and joined back to the documents with plain exchanges on both sides, so Spark splits a group with a third of all rows; if
their files are small, it broadcasts them instead. Texts are cut and hashed once; the written chunks serve all that follows.

Defined cases: a null text counts as empty, all empty texts form one group; repeated (doc_id, text) rows each give a
row, count in ``group_size`` and stay or go together; a null id is never the one kept of a group with other ids; an empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolyte.llm.common import SPACE, text_or_empty, without, written

#: A chunk ends at the first sentence end after this many characters, and after the larger number in any case.
CHUNK_MIN, CHUNK_MAX = 512, 4096


def normalised(text: Column) -> Column:
    """White-space runs become one space; nothing is trimmed."""
    return F.regexp_replace(text, SPACE, " ")


def chunks(norm: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """The ordered chunks of a text; joined they give the text back."""
    pattern = rf"(?s).{{{least},{most}}}?(?<=[.!?;:。！？] )|.{{1,{most}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, hash_of: Callable[[Column], Column] = chunk_hash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, sha256, ids): the verified ordered identifier list of each document.

    ``ids`` is an array of (hash, rank) pairs packed as hash values with ranks appended only where a hash stands for
    several chunks. ``hash_of`` can be weakened in tests to force that path.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(text_or_empty(text_col)).alias("norm"))
    cut = base.select("doc_id", F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks"))
    rows = cut.select("doc_id", "text_sha256", F.transform("chunks", hash_of).alias("ids"), "chunks", F.monotonically_increasing_id().alias("row_id"))
    rows = written(rows, "recipes")

    distinct = rows.select(F.explode("chunks").alias("chunk")).select(hash_of(F.col("chunk")).alias("h"), "chunk").distinct()
    clashing = written(distinct.groupBy("h").count().where("count > 1").select("h"), "clashes")
    if clashing.isEmpty():
        return rows.select("doc_id", "text_sha256", F.col("ids").cast(T.ArrayType(T.StringType())).alias("ids"))

    # Several chunks share a hash: rank them by their text, and put the ranks into the lists that hold such chunks.
    ranks = distinct.join(clashing, "h", "left_semi").groupBy("h").agg(F.array_sort(F.collect_set("chunk")).alias("texts"))
    parts = rows.select("row_id", F.posexplode_outer("chunks").alias("pos", "chunk")).withColumn("h", hash_of(F.col("chunk")))
    parts = parts.join(ranks, "h", "left").select(
        "row_id", "pos", F.when(F.col("texts").isNull(), F.col("h").cast("string")).otherwise(F.concat_ws(":", "h", F.array_position("texts", F.col("chunk")))).alias("id")
    )
    lists = parts.groupBy("row_id").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id")))).alias("l"))
    return rows.join(lists, "row_id").select("doc_id", "text_sha256", F.col("l.id").alias("ids"))


def exact_dedup(docs: DataFrame, hash_of: Callable[[Column], Column] = chunk_hash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = recipes(docs, hash_of, id_col, text_col)
    key = F.array_join("ids", ",")
    rows = rows.select("doc_id", "text_sha256", key.alias("recipe"))
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return (
        rows.join(written(groups, "groups"), "recipe", "left")
        .withColumn("keep_id", F.coalesce("keep_id", "doc_id"))
        .select("doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    return without(docs, exact_dedup(docs).where(~F.col("kept")))
