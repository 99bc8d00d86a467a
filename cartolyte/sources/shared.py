"""Tables written to the folder that driver and executors share, where a lineage has to end or several readers follow."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of this process, which only a single machine can do with."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return _own_folder()
    raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")


#: What this process has written to the shared folder and not cleaned up yet.
_made: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    _made.append(f"{shared_dir(spark)}/cartolyte-{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def clean_up(spark: SparkSession) -> int:
    """Delete all that this process has written to the shared folder, for a caller that is done with all results; how many tables that were."""
    conf, gone = spark._jsc.hadoopConfiguration(), 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet and read back: a lost executor costs a re-read of files, not a rerun of what was before."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """How many tasks work is spread over where a table's own splits are too few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows spread over tasks: they are few bytes where what is made of them is not."""
    return df.repartition(tasks(df.sparkSession), key)
