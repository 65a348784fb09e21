"""Joins of points to half-open intervals, as equi-joins on bins.

An interval is at home on the level whose bins are as wide as its length, rounded up to a power
of two: it meets two bins of them at most, however long it is. A point has one bin on each
level that has intervals, of which there are as many as lengths differ in magnitude. Points
and intervals that share level, bin and keys are held against each other exactly. So Spark
hashes and sorts as for any equi-join; nothing is compared with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_number(df: DataFrame, column: str) -> Column:
    """Dates by days, times by microseconds, numbers as they are."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def interval_join(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of points with each interval of the same ``keys`` for which lo <= at < hi. A null
    ``lo`` or ``hi`` is open; a null ``at``, a null key and an empty interval meet nothing."""
    x = as_number(points, at)
    ends = points.agg(F.min(x).alias("least"), F.max(x).alias("most")).first()
    least, most = ends if ends["least"] is not None else (0.0, 0.0)
    # No point is beyond these, so open ends are closed there.
    start, end = F.coalesce(F.greatest(as_number(intervals, lo), F.lit(least)), F.lit(least)), F.coalesce(F.least(as_number(intervals, hi), F.lit(most + 1)), F.lit(most + 1))
    held = intervals.withColumns({"_start": start, "_end": end}).filter("_start < _end")
    held = held.withColumn("_level", F.ceil(F.log2(F.col("_end") - F.col("_start"))).cast("int"))
    levels = sorted(r[0] for r in held.select("_level").distinct().collect())  # magnitudes of doubles
    wide = F.pow(F.lit(2.0), F.col("_level"))
    first, last = F.floor(F.col("_start") / wide), F.floor(F.col("_end") / wide)
    held = held.withColumn("_bin", F.explode(F.array_distinct(F.array(first, last))))
    own = points.withColumn("_at", x).withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    own = own.withColumn("_bin", F.floor(F.col("_at") / wide))
    met = own.join(held, [*keys, "_level", "_bin"]).filter("_start <= _at AND _at < _end")
    return met.drop("_start", "_end", "_at", "_level", "_bin")
