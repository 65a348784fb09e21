"""Sources, sinks, state machines and line passes bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.functions import line_passes as lp
from lexiquarry.plans.registry import Registry
from lexiquarry.session import scratch_dir, table
from lexiquarry.sources import readers as rd
from lexiquarry.sources import writers as wr
from lexiquarry.streaming import queue as q

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


def fold_sql(first: str, step: str) -> str:
    """A fold of each user's events as recursive SQL: columns of the first event (e), and of
    each next one by the row before (s)."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, CAST(epoch_us(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 1e6 AS t, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 s AS (SELECT key, seq, n, t, {first} FROM e WHERE n = 1 UNION ALL SELECT e.key, e.seq, e.n, e.t, {step} FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1) SELECT key, seq, decision FROM s"""


_DAY = "CAST(86400 AS DOUBLE)"
_TOKENS = "least(CAST(3 AS DOUBLE), s.tokens + greatest(CAST(0 AS DOUBLE), e.t - s.t) * (CAST(1 AS DOUBLE) / 43200))"
_MINUTE = "least(CAST(2 AS DOUBLE), s.m + greatest(CAST(0 AS DOUBLE), e.t - s.t) * (CAST(2 AS DOUBLE) / 60))"
_DAILY = f"least(CAST(5 AS DOUBLE), s.d + greatest(CAST(0 AS DOUBLE), e.t - s.t) * (CAST(5 AS DOUBLE) / {_DAY}))"
_RESTS = f"(s.state = 'OPEN' AND e.t - s.since < {_DAY})"
_TRIES = "CASE WHEN s.state = 'OPEN' THEN 2 ELSE s.bad + 1 END"
FOLDS = {
    "ss6": fold_sql("t AS at_, 'miss' AS decision", f"CASE WHEN e.t - s.at_ < {_DAY} THEN s.at_ ELSE e.t END, CASE WHEN e.t - s.at_ < {_DAY} THEN 'hit' ELSE 'miss' END"),
    "ss8": fold_sql("CAST(2 AS DOUBLE) AS tokens, 'allow' AS decision", f"CASE WHEN {_TOKENS} >= 1 THEN {_TOKENS} - 1 ELSE {_TOKENS} END, CASE WHEN {_TOKENS} >= 1 THEN 'allow' ELSE 'deny' END"),
    "ss9": fold_sql("CAST(1 AS DOUBLE) AS m, CAST(4 AS DOUBLE) AS d, 'allow' AS decision", f"CASE WHEN {_MINUTE} >= 1 AND {_DAILY} >= 1 THEN {_MINUTE} - 1 WHEN {_MINUTE} >= 1 THEN {_MINUTE} - 1 + 1 ELSE {_MINUTE} END, CASE WHEN {_MINUTE} >= 1 AND {_DAILY} >= 1 THEN {_DAILY} - 1 WHEN {_DAILY} >= 1 THEN {_DAILY} - 1 + 1 ELSE {_DAILY} END, CASE WHEN {_MINUTE} >= 1 AND {_DAILY} >= 1 THEN 'allow' ELSE 'deny' END"),
    "ss10": fold_sql("'CLOSED' AS state, CASE WHEN v > 0 THEN 1 ELSE 0 END AS bad, t AS since, 'CLOSED' AS decision", f"CASE WHEN {_RESTS} THEN s.state WHEN e.v > 0 AND {_TRIES} >= 2 THEN 'OPEN' ELSE 'CLOSED' END, CASE WHEN {_RESTS} THEN s.bad WHEN e.v > 0 THEN {_TRIES} ELSE 0 END, CASE WHEN {_RESTS} THEN s.since WHEN e.v > 0 AND {_TRIES} < 2 THEN s.since ELSE e.t END, CASE WHEN {_RESTS} THEN 'OPEN' WHEN s.state = 'OPEN' THEN 'HALF_OPEN' ELSE 'CLOSED' END"),
    "ss13": fold_sql(f"CASE WHEN v > 0 THEN t + {_DAY} ELSE CAST(-1e18 AS DOUBLE) END AS until, 'free' AS decision", f"CASE WHEN e.v > 0 AND e.t >= s.until THEN e.t + {_DAY} ELSE s.until END, CASE WHEN e.t < s.until THEN 'resting' ELSE 'free' END"),
}


def events(spark, d):
    e = table(spark, d, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), seconds.alias("seconds"), F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("value"))


@reg("ss2_retry_dead_letter", "WITH x AS (SELECT event_id, user_id, event_type = 'error' AS bad, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tries FROM events) SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, CASE WHEN NOT bad THEN 'done' WHEN tries >= 3 THEN 'dead' ELSE 'retry' END AS decision FROM x")
def ss2(spark, d):
    return q.fold_batch(events(spark, d), q.retry_queue(3))


@reg("ss6_ttl_cache", FOLDS["ss6"])
def ss6(spark, d):
    return q.fold_batch(events(spark, d), q.ttl_cache(86400.0))


@reg("ss8_token_bucket", FOLDS["ss8"])
def ss8(spark, d):
    return q.fold_batch(events(spark, d).withColumn("value", F.lit(1.0)), q.token_bucket(3, 1 / 43200))


@reg("ss9_dual_bucket", FOLDS["ss9"])
def ss9(spark, d):
    return q.fold_batch(events(spark, d), q.dual_bucket(2, 5))


@reg("ss10_circuit_breaker", FOLDS["ss10"])
def ss10(spark, d):
    return q.fold_batch(events(spark, d), q.circuit_breaker(2, 86400.0))


@reg("ss13_key_cooldown", FOLDS["ss13"])
def ss13(spark, d):
    return q.fold_batch(events(spark, d), q.cooldown(86400.0))


@reg("ss5_queue_metrics", "SELECT count(*) AS depth, count(*) FILTER (event_type = 'error') AS dead, count(*) FILTER (event_type = 'view') AS pending FROM events")
def ss5(spark, d):
    """Taken in the pass that fills the queue."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    got = wr.write_observed(e, lambda x: q.enqueue(x, f"{scratch_dir(spark)}/queue"), depth=F.count("*"), dead=F.count_if(F.col("event_type") == "error"), pending=F.count_if(F.col("event_type") == "view"))
    return spark.createDataFrame([(got["depth"], got["dead"], got["pending"])], "depth long, dead long, pending long")


@reg("sc4_sheet_markdown", "SELECT r.r_name AS sheet, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS text FROM nation JOIN region r ON r_regionkey = n_regionkey GROUP BY 1")
def sc4(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("r_name").alias("sheet"), F.col("n_nationkey").cast("long").alias("n"), F.array("n_name", F.col("n_nationkey").cast("string")).alias("cells"))
    head = n.select(F.col("r_name").alias("sheet")).distinct().withColumns({"n": F.lit(-1).cast("long"), "cells": F.array(F.lit("name"), F.lit("key"))})
    return rd.sheet_markdown(rows.unionByName(head), "sheet", "n", "cells")


@reg("sc7_master_catalog", "SELECT s_suppkey AS n, 's' || s_suppkey AS slug, CASE WHEN s_suppkey % 2 = 0 THEN 'bundle ' || s_suppkey ELSE s_name END AS title FROM supplier")
def sc7(spark, d):
    s = table(spark, d, "supplier")
    slug = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    none = F.lit(None).cast("string")
    registry = s.select(F.col("s_suppkey").alias("n"), slug.alias("slug"), slug.alias("path"), none.alias("id"), none.alias("number"), F.col("s_name").alias("title"))
    bundles = s.filter("s_suppkey % 2 = 0").select(F.when(F.col("s_suppkey") % 4 == 0, slug).alias("path"), slug.alias("slug"), none.alias("id"), none.alias("number"), F.concat(F.lit("bundle "), F.col("s_suppkey").cast("string")).alias("title"))
    return rd.merged_catalog(registry, bundles).select("n", "slug", "title")


@reg("sc10_relational_scan", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'unknown') AS id FROM orders")
def sc10(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("unknown")).alias("id"))


@reg("sc11_parent_filter_scan", "SELECT doc_id FROM documents WHERE doc_id IN (1, 5, 9, 200) AND source LIKE 'src%'")
def sc11(spark, d):
    return table(spark, d, "documents").filter(F.col("doc_id").isin(1, 5, 9, 200) & F.col("source").startswith("src")).select("doc_id")


@reg("sc12_parameterised_read", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def sc12(spark, d):
    return spark.sql("SELECT n_name FROM {nation} WHERE n_regionkey = :r", args={"r": 2}, nation=table(spark, d, "nation"))


@reg("sk1_index_insert", "SELECT CAST(vec_id AS VARCHAR) AS doc_id, substr(coalesce(text, ''), 1, 14000) AS text, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 64 END AS nonzero FROM embeddings LEFT JOIN documents ON doc_id = vec_id")
def sk1(spark, d):
    e = table(spark, d, "embeddings").join(table(spark, d, "documents").withColumnRenamed("doc_id", "vec_id"), "vec_id", "left")
    vector = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 5)).otherwise(F.transform("embedding", lambda x: F.lit(1.0).cast("float")))
    rows = e.select(F.col("vec_id").alias("doc_id"), "text", F.lit(None).cast("string").alias("summary"), F.lit("3").alias("page"), F.lit(None).cast("boolean").alias("is_table"), vector.alias("vector"), F.create_map(F.lit(-1).cast("long"), F.lit(0.5)).alias("sparse"))
    return wr.index_rows(rows, 64).select("doc_id", "text", F.size(F.filter("vector", lambda x: x != 0)).alias("nonzero"))


@reg("sk4_enrich_index", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'own' END AS authority FROM documents")
def sk4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("authority"))
    chunks = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 2 == 0, "Unknown").otherwise("own").alias("authority"))
    return wr.enriched_chunks(chunks, docs, ["authority"])


@reg("sk13_nested_export", "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def sk13(spark, d):
    x = wr.nested_export(table(spark, d, "conversations"), ["conv_id"], ["turn"])
    return x.select("conv_id", F.size("chunks").cast("long").alias("n"), F.array_join(F.transform("chunks", lambda c: c["role"]), ",").alias("roles"))


@reg("sk14_markdown_export", "WITH f AS (SELECT conv_id, trim(text) AS t, min(turn) AS turn, min_by(role, turn) AS role FROM conversations GROUP BY 1, 2) SELECT CAST(conv_id AS VARCHAR) AS doc_id, md5(string_agg('## ' || role || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY turn)) AS h FROM f GROUP BY 1")
def sk14(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.col("turn").alias("n"), F.col("role").alias("heading"), "text")
    return wr.markdown_export(c).select("doc_id", F.md5(F.col("markdown").cast("binary")).alias("h"))


@reg("tx1_composite_cleaner")
def tx1(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(lp.apply(F.col("text"), *lp.CLEANER).cast("binary")).alias("h"))


@reg("tx16_paragraph_rejoin")
def tx16(spark, d):
    x = lp.apply(F.col("text"), lp.rejoin_paragraphs)
    return table(spark, d, "documents").select("doc_id", F.size(F.split(x, "\n")).alias("paragraphs"))
