"""Reports on a request log, retention, counters and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def model_report(log: DataFrame, group: str = "model") -> DataFrame:
    """Requests, success share, tokens, latency mean and percentiles of each model."""
    pct = lambda p: F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY latency)")
    return log.groupBy(group).agg(
        F.count("*").alias("requests"),
        (100.0 * F.count_if(F.col("status") == "success") / F.count("*")).alias("success_pct"),
        F.sum("tokens").alias("tokens"),
        F.avg("latency").alias("avg_latency"),
        pct(0.5).alias("p50"),
        pct(0.9).alias("p90"),
        pct(0.99).alias("p99"),
    )


def daily_trend(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.countDistinct("key").alias("keys"))


def summary_and_top(log: DataFrame, k: int = 4) -> DataFrame:
    """A total row and the k models with most requests."""
    total = log.agg(F.lit("TOTAL").alias("model"), F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    top = log.groupBy("model").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens")).orderBy(F.desc("requests"), "model").limit(k)
    return total.unionByName(top)


def rate_and_eta(state: DataFrame, status: str, recent: Column, minutes: float = 5.0) -> DataFrame:
    """Completed in the last minutes over these minutes; what is left over this rate."""
    done = F.count_if((F.col(status) == "COMPLETED") & recent) / F.lit(minutes)
    left = F.count_if(F.col(status).isin("PENDING", "CLAIMED"))
    return state.agg(done.alias("rate"), left.alias("left")).withColumn("eta_minutes", F.try_divide(F.col("left"), F.col("rate")))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def hit_rate(df: DataFrame, hit: Column) -> DataFrame:
    """Hits, misses and 100 * hits / all."""
    return df.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses")).withColumn("hit_pct", 100.0 * F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)))


def cumulative_buckets(df: DataFrame, value: str, bounds: list[float], *keys: str) -> DataFrame:
    """Histogram rows (keys, le, n): values up to each bound, and all (le infinite)."""
    cols = [F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds]
    cols.append(F.struct(F.lit(float("inf")).alias("le"), F.count("*").alias("n")))
    return df.groupBy(*keys).agg(F.array(*cols).alias("b")).select(*keys, F.inline("b"))


def histogram_quantile(buckets: DataFrame, q: float, *keys: str) -> DataFrame:
    """Linear interpolation within the bucket of the quantile; in the last bucket its
    lower bound. buckets: (keys, le, n), n cumulative."""
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    w = part.orderBy("le")
    b = buckets.withColumns({"below": F.coalesce(F.lag("n").over(w), F.lit(0)), "lower": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "total": F.max("n").over(part)})
    b = b.filter((F.col("n") >= q * F.col("total")) & (F.col("below") < q * F.col("total")))
    inside = F.col("lower") + (F.col("le") - F.col("lower")) * (q * F.col("total") - F.col("below")) / (F.col("n") - F.col("below"))
    return b.select(*keys, F.when(F.col("le") == float("inf"), F.col("lower")).otherwise(inside).alias("quantile"))


def windowed_rate(events: DataFrame, ts: str, length: str, slide: str, bad: Column, *keys: str) -> DataFrame:
    """Share of bad events in sliding windows."""
    g = events.groupBy(F.window(ts, length, slide).alias("w"), *keys).agg(F.count_if(bad).alias("bad"), F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), *keys, "bad", "n", (F.col("bad") / F.col("n")).alias("share"))


def sustained(windows: DataFrame, holds: Column, k: int, seconds: int, *keys: str, start: str = "start") -> DataFrame:
    """Windows that end a run of at least k windows of a series (``keys``), each holding and
    each ``seconds`` after the one before; ``len`` is the run's length so far."""
    at = F.unix_seconds(F.col(start).cast("timestamp"))
    w = W.partitionBy(*keys).orderBy(start)
    # Windows in a row keep their time less their number.
    runs = windows.filter(holds).withColumn("run", at - F.row_number().over(w) * seconds)
    return runs.withColumn("len", F.row_number().over(W.partitionBy(*keys, "run").orderBy(start))).filter(F.col("len") >= k).drop("run")


def latest_top(df: DataFrame, key: str, value: str, ts: str, tie: str, k: int) -> DataFrame:
    """The k largest of the latest values of each series."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(ts, tie)).alias("latest")).orderBy(F.desc("latest"), key).limit(k)


def retained(df: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    return df.filter(F.col(ts) >= cutoff)


def expired(df: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    return df.filter(F.col(ts) < cutoff)


def fixed_window_quota(events: DataFrame, key: str, ts: str, hours: int, quota: int) -> DataFrame:
    """Requests of each key in windows counted from its first request, and whether they
    are below 95 % of the quota."""
    first = F.min(ts).over(W.partitionBy(key))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    n = F.floor((micros(F.col(ts)) - micros(first)) / F.lit(hours * 3_600_000_000))
    return events.withColumn("window_no", n).groupBy(key, "window_no").agg(F.count("*").alias("n")).withColumn("safe", F.col("n") < 0.95 * quota)
