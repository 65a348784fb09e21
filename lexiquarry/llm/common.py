"""Spark helpers of this package."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII spaces.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir. Where it is unset, a folder of our own serves
    a local session (tests); on a cluster, whose machines don't share folders, that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lexiquarry-checkpoint-")
    sc.setCheckpointDir(where)


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint that every executor can read again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(text: str = "text"):
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _tables(spark: SparkSession) -> str:
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/lexiquarry-{spark.sparkContext.applicationId}"


def clear_stored(spark: SparkSession) -> None:
    """Removes all tables that ``stored`` wrote in this application. DataFrames that still
    read them can't be used any more; long sessions call it between jobs."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(_tables(spark))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: smaller than a
    checkpoint, and later reads take only the columns and rows they need. It stays until
    ``clear_stored``, as the rows of a result may still depend on it."""
    spark = df.sparkSession
    shared_dir(spark)
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker together.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same rows; Arrow batches of the session stay small, whatever the rows' sizes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


#: Bytes, by Spark's statistics, up to which a stored table is broadcast.
SMALL_BYTES = 32 << 20


def small(table: DataFrame) -> DataFrame:
    """A stored table marked for broadcast if it is small by its files, else for a
    shuffled hash join that builds on it."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(table) if size <= SMALL_BYTES else table.hint("shuffle_hash")
