"""Indexes that a session builds once for a table and reads in every later query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from lexiquarry.session import scratch_dir

_PATHS: dict[tuple, str] = {}


def files_of(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of every file of a table, as Spark's file system tells them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found, each = [], fs.listFiles(at, True)
    while each.hasNext():
        f = each.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def stored_index(spark: SparkSession, kind: str, table: str, build: Callable[[str], object]) -> str:
    """The folder of an index of ``kind`` over the table at ``table``. ``build`` writes it to a
    new folder, once for the table's files as they are: a changed table is indexed anew."""
    key = (spark.sparkContext.applicationId, kind, files_of(spark, table))
    if key not in _PATHS:
        path = scratch_dir(spark)
        build(path)
        _PATHS[key] = path
    return _PATHS[key]
