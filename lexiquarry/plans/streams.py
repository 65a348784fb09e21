"""Queues, limiters and caches over the events, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.plans.registry import Registry
from lexiquarry.plans.stores import _DAY, events, fold_sql
from lexiquarry.session import scratch_dir, table
from lexiquarry.plans import telemetry
from lexiquarry.streaming import queue as q
from lexiquarry.streaming import windows as win

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

MESSAGE = "user_id long, event_id long, event_type string"


def _queued(spark, d) -> tuple[str, object]:
    path = f"{scratch_dir(spark)}/queue"
    q.enqueue(table(spark, d, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), "event_type"), path)
    return path, q.queue_scan(spark, path, MESSAGE)


@reg("ss1_enqueue", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def ss1(spark, d):
    path, _ = _queued(spark, d)
    return spark.read.json(path).filter("enqueued_at IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n"))


@reg("sc13_queue_scan", "SELECT user_id, event_id, event_type FROM events")
def sc13(spark, d):
    path, stream = _queued(spark, d)
    return q.drained(stream, f"{path}-read")


@reg("ss3_claim_through_state", "WITH f AS (SELECT user_id AS doc, min(event_id) AS seq FROM events GROUP BY 1) SELECT doc, seq, 'processing' AS status FROM f LEFT JOIN orders ON o_orderkey = doc WHERE coalesce(o_orderstatus <> 'F', true)")
def ss3(spark, d):
    path, stream = _queued(spark, d)
    queue = q.drained(stream, f"{path}-read").select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"))
    state = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), "o_orderstatus")
    return q.claimed_messages(queue, state, "doc", F.col("o_orderstatus") != "F")


@reg("ss4_backpressure", "WITH b AS (SELECT event_id // 500 AS batch, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1) SELECT batch, n, CASE WHEN bad * 20 > n * 2 THEN 0 ELSE n END AS admitted FROM b")
def ss4(spark, d):
    b = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 500).alias("batch")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return q.admitted(b, b.filter("bad * 20 > n * 2"), "batch", "n").select("batch", "n", "admitted")


@reg("ss7_semantic_cache")
def ss7(spark, d):
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("label").cast("string").alias("key"), F.col("vec_id").cast("long").alias("seq"), F.col("vec_id").cast("double").alias("seconds"), F.col("embedding").alias("vector"))
    return q.semantic_cache(rows, ttl=1000.0, least=0.6, capacity=50)


_AWAY = "CAST(432000 AS DOUBLE)"
_CLIENT = f"CASE WHEN e.t - s.t > {_AWAY} THEN CAST(2 AS DOUBLE) ELSE least(CAST(2 AS DOUBLE), s.tokens + greatest(CAST(0 AS DOUBLE), e.t - s.t) * (CAST(1 AS DOUBLE) / {_DAY})) END"


@reg("ss12_per_client_limiter", fold_sql("CAST(1 AS DOUBLE) AS tokens, 'allow' AS decision", f"CASE WHEN {_CLIENT} >= 1 THEN {_CLIENT} - 1 ELSE {_CLIENT} END, CASE WHEN {_CLIENT} >= 1 THEN 'allow' ELSE 'deny' END"))
def ss12(spark, d):
    return q.fold_batch(events(spark, d), q.per_client(2, 1 / 86400, 432000.0))


@reg("ss14_semaphore", fold_sql("[t + CAST(500000 AS DOUBLE)] AS held, 'acquired' AS decision", "CASE WHEN len(list_filter(s.held, lambda x: x > e.t)) < 2 THEN list_append(list_filter(s.held, lambda x: x > e.t), e.t + CAST(500000 AS DOUBLE)) ELSE list_filter(s.held, lambda x: x > e.t) END, CASE WHEN len(list_filter(s.held, lambda x: x > e.t)) < 2 THEN 'acquired' ELSE 'full' END"))
def ss14(spark, d):
    return q.fold_batch(events(spark, d), q.semaphore(2, 500000.0))


@reg("ss20_answer_events", "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'assistant'), e AS (SELECT conv_id, turn, [('context', NULL)] || list_transform(w, lambda x: ('token', x)) || [('trace', NULL), ('done', NULL)] AS e FROM w), u AS (SELECT conv_id, turn, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS n FROM e) SELECT conv_id, turn, n, x[1] AS type, x[2] AS data FROM u")
def ss20(spark, d):
    return q.answer_events(table(spark, d, "conversations").filter("role = 'assistant'"), "conv_id", "turn", "text")


def event_stream(spark, d, slices: int = 4):
    """The events as a stream of files in order of time, a file for each trigger. A last event,
    far behind the others, closes their windows and stays in an open one itself."""
    path = f"{scratch_dir(spark)}/events"
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    at = F.unix_micros("ts")
    cuts = e.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 1000).alias("cuts"), F.max("ts").alias("last")).first()
    bounds = [None, *sorted(set(cuts["cuts"] or [])), None]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = e.filter((at > lo) if lo is not None else F.lit(True)).filter((at <= hi) if hi is not None else F.lit(True))
        part.write.mode("append").parquet(path)
    if cuts["last"] is not None:
        last = e.limit(1).select(F.lit(-1).cast("long").alias("event_id"), (F.lit(cuts["last"]) + F.expr("INTERVAL 30 DAYS")).alias("ts"), "user_id", "event_type", "value")
        last.write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _told(spark, d, stream):
    """What a stream told, its times as the table has them."""
    kind = table(spark, d, "events").schema["ts"].dataType
    out = win.drain(stream, scratch_dir(spark))
    return out.withColumns({c: F.col(c).cast(kind) for c in ("start", "end") if c in out.columns})


@reg("ss15_counter_rate_stream", telemetry.ORACLES["ss15_counter_rate"])
def ss15_stream(spark, d):
    s = win.rates(event_stream(spark, d), "ts", "10 minutes", "1 hour", F.col("event_type") == "error")
    return _told(spark, d, s).withColumn("share", F.round("share", 6))


@reg("ss17_group_rate_stream", telemetry.ORACLES["ss17_group_rate"])
def ss17_stream(spark, d):
    s = win.rates(event_stream(spark, d), "ts", "10 minutes", "1 day", F.col("value") > 50, "event_type")
    return _told(spark, d, s).withColumn("share", F.round("share", 6))


@reg("ss19_conjunctive_alert_stream", f"WITH {telemetry._HOLDS} SELECT a.grp, a.start + INTERVAL 6 HOUR AS \"end\", CAST(2 AS BIGINT) AS held FROM r a JOIN r b ON a.grp = b.grp AND b.start = a.start - INTERVAL 6 HOUR")
def ss19_stream(spark, d):
    e = event_stream(spark, d).withColumn("grp", F.col("user_id") % 4)
    errors = win.counted(e, "ts", "10 minutes", "6 hours", F.lit(True), "grp", where=F.col("event_type") == "error").select("w", "grp", "bad")
    every = win.counted(e, "ts", "10 minutes", "6 hours", F.lit(True), "grp").select("w", "grp", "n")
    both = win.conjunction(errors, every, "grp")
    return _told(spark, d, win.sustained(both, (F.col("bad") >= 1) & (F.col("n") > 2), "6 hours", 2, "grp"))
