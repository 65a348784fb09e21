"""Maintenance operators bound to small inline rows or the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.operators import documents as o
from lexiquarry.operators import upkeep as u
from lexiquarry.operators.metrics import numbered_within
from lexiquarry.plans.registry import Registry
from lexiquarry.session import table

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


@reg("mx10_recoverable", "WITH x AS (SELECT doc_id, text, len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) AS n FROM documents) SELECT doc_id, length(text) >= 50 AND n >= 2 AS ok FROM x")
def mx10(spark, d):
    return table(spark, d, "documents").select("doc_id", u.recoverable(F.col("text")).alias("ok"))


_EN = "|".join(u.ENGLISH)


@reg("mx12_english_summary", f"SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(?:{_EN})\\b')) > 5 AS english FROM documents")
def mx12(spark, d):
    return table(spark, d, "documents").select("doc_id", u.is_english(F.col("text")).alias("english"))


@reg("mx11_placeholder_recovery", "SELECT conv_id AS doc, turn AS page, CASE WHEN turn % 2 = 0 THEN role ELSE 'kept' END AS text FROM conversations")
def mx11(spark, d):
    c = table(spark, d, "conversations").dropDuplicates(["conv_id", "turn"]).select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "role")
    pages = c.select("doc", "page", F.when(F.col("page") % 2 == 0, "[placeholder]").otherwise("kept").alias("text"))
    return u.placeholder_recovered(pages, c.select("doc", "page", F.lit(0).alias("n"), F.col("role").alias("text")), "[placeholder]")


@reg("mx18_rechunk_if_improved")
def mx18(spark, d):
    docs = table(spark, d, "documents")
    old = docs.select("doc_id", F.lit("child").alias("chunk_type"))
    return u.better_chunking(old, o.fallback_chunks(docs, "doc_id", "text"), "doc_id")


@reg("mx40_flag_record", "SELECT user_id, round(avg(value), 6) AS mean, CAST(least(count(*), 3) AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type DESC) AS k FROM events) WHERE k <= 5 GROUP BY 1 HAVING avg(value) < 120")
def mx40(spark, d):
    return u.flagged(table(spark, d, "events"), "user_id", "value", "event_type", 120.0).select("user_id", F.round("mean", 6).alias("mean"), F.size("texts").alias("n"))


@reg("mx19_metadata_back_fill", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'own' END AS number FROM supplier")
def mx19(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, "own").alias("number"))
    index = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return s.join(index, "s_suppkey", "left").select("s_suppkey", F.coalesce("number", "s_name").alias("number"))


@reg("mx5_bundle_chunks", "SELECT doc_id, source || '::c' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS chunk_id FROM documents")
def mx5(spark, d):
    x = numbered_within(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", "n")
    return x.select("doc_id", F.concat("source", F.lit("::c"), F.col("n").cast("string")).alias("chunk_id"))


@reg("mx15_low_text_sample", "SELECT conv_id FROM (SELECT conv_id, min(turn) AS t FROM conversations WHERE turn = 1 AND length(text) < 200 GROUP BY 1) ORDER BY md5(CAST(conv_id AS VARCHAR)) LIMIT 10")
def mx15(spark, d):
    c = table(spark, d, "conversations").filter((F.col("turn") == 1) & (F.length("text") < 200)).select("conv_id").distinct()
    return c.orderBy(F.md5(F.col("conv_id").cast("string").cast("binary"))).limit(10)


@reg("mx36_context_fetch", "SELECT source, string_agg(text, chr(10) ORDER BY doc_id) AS context FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 5 GROUP BY 1")
def mx36(spark, d):
    from pyspark.sql import Window as W

    x = table(spark, d, "documents").withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).filter("k <= 5")
    rows = F.array_sort(F.collect_list(F.struct("k", F.col("text").alias("s"))))
    return x.groupBy("source").agg(F.array_join(F.transform(rows, lambda r: r["s"]), "\n").alias("context"))
