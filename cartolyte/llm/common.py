"""What the operators share: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cartolyte.sources.shared import new_path

#: White space as every word operator here sees it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    The lineage ends here, so a lost executor costs a re-read of these files, not a rerun of the stages before. Tables that
    nothing drops stay until :func:`cartolyte.sources.shared.clean_up`.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table from :func:`written` that nothing will read again."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Rows that Python is given at once, at most; texts can be long, and Spark's default of 10,000 rows knows no size.
BATCH_ROWS = 2000


def bounded_batches(df: DataFrame) -> None:
    """Set the session's Arrow batches to ``BATCH_ROWS``, unless somebody chose a number."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))


def ids_as_text(docs: DataFrame, id_col: str, *others: Column) -> DataFrame:
    """doc_id as a string, with other columns: pandas would turn integers among nulls into floating point."""
    bounded_batches(docs)
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), *others)


def ids_restored(df: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """``df`` with doc_id of the type that ``docs`` has."""
    return df.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


#: Bytes of ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 16_000_000


def _broadcast_if_small(ids: DataFrame) -> DataFrame:
    """A written table of one column of ids, to be broadcast if its values, measured first, are few or short enough."""
    (name,) = ids.columns
    width = F.lit(8) if isinstance(ids.schema[name].dataType, NumericType) else F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + 8
    return F.broadcast(ids) if (ids.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else ids


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose doc_id is in ``gone``. The documents move only if the ids are too many to broadcast."""
    ids = _broadcast_if_small(written(gone.select(F.col("doc_id").alias("_gone")), "gone"))
    return docs.join(ids, docs["doc_id"] == ids["_gone"], "left_anti")


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``; the same way of joining."""
    ids = _broadcast_if_small(written(ids.select(F.col("doc_id").alias("_own")).distinct(), "own"))
    return docs.join(ids, docs["doc_id"] == ids["_own"], "left_semi")
