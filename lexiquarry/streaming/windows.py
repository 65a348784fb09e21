"""Rates and alerts over event-time windows, as streams.

Events are counted in windows behind a watermark; a window is told once, when the watermark
passes its end, and rows that come in a later batch than that are left out. A conjunctive alert joins two
such series, stream with stream, by window and labels; it is sustained where as many windows in
a row hold, which a count over a longer window of the windows' own times tells. All state is
Spark's: counts of open windows, and rows of a join until their window is closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(events: DataFrame, ts: str, late: str, length: str, bad: Column, *keys: str, slide: str | None = None, where: Column | None = None) -> DataFrame:
    """(w, keys, bad, n): a stream's windows behind a watermark of ``late``. Rows that ``where``
    leaves out count for the watermark all the same, so that rare ones hold nothing up."""
    # A filter before the windows would go below the watermark.
    own = F.lit(True) if where is None else where
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, length, slide or length).alias("w"), *keys)
    return counts.agg(F.count_if(own & bad).alias("bad"), F.count_if(own).alias("n")).filter("n > 0")


def rates(events: DataFrame, ts: str, late: str, length: str, bad: Column, *keys: str, slide: str | None = None) -> DataFrame:
    """(start, keys, bad, n, share): the share of bad events in each closed window."""
    c = counted(events, ts, late, length, bad, *keys, slide=slide)
    return c.select(F.col("w.start").alias("start"), *keys, "bad", "n", (F.col("bad") / F.col("n")).alias("share"))


def conjunction(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Two series of windows, joined by window and labels: (w, keys, left's and right's columns)."""
    return left.join(right, ["w", *keys])


def sustained(windows: DataFrame, holds: Column, length: str, k: int, *keys: str) -> DataFrame:
    """(end, keys, held): where each of the last ``k`` windows of ``length`` holds."""
    at = windows.filter(holds).select("w", *keys)
    span = f"{k * int(length.split()[0])} {length.split()[1]}"
    runs = at.groupBy(F.window(F.window_time("w"), span, length).alias("run"), *keys).agg(F.count("*").alias("held"))
    return runs.filter(F.col("held") == k).select(F.col("run.end").alias("end"), *keys, "held")


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what its source has, and returns what it told. The checkpoint and
    the rows lie below ``path``, so a run that is broken off goes on where it was."""
    run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
