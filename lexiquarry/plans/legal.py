"""References, tables, anchors and citations; small inline rows or the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.functions.text import STOPWORDS, content_tokens, token_recall
from lexiquarry.operators import legal as g
from lexiquarry.plans.documents import FOLDED
from lexiquarry.plans.registry import Registry
from lexiquarry.session import scratch_dir, table
from lexiquarry.sources.keyed_store import KeyedStore

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


@reg("fn10_softmax", "SELECT event_id, round(exp(0.0) / (1 + exp(-value / 50) + exp(-value / 25)), 6) AS p FROM events")
def fn10(spark, d):
    l = F.array(F.lit(0.0), -F.col("value") / 50, -F.col("value") / 25)  # noqa: E741
    return table(spark, d, "events").select("event_id", F.round(g.softmax3(l, (0, 1, 2))[0], 6).alias("p"))


_TOK = "list_filter(list_distinct(list_filter(string_split(regexp_replace(" + FOLDED + ", '[^a-z0-9%]+', ' ', 'g'), ' '), lambda w: length(w) > 1)), lambda w: NOT list_contains([" + ",".join(f"'{w}'" for w in STOPWORDS) + "], w))"


@reg("fn9_token_recall", f"WITH t AS (SELECT doc_id, {_TOK} AS w FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(a.w) END, 6) AS recall FROM t a JOIN t b ON b.doc_id = a.doc_id + 1")
def fn9(spark, d):
    x = table(spark, d, "documents").select("doc_id", content_tokens(F.col("text")).alias("w"))
    y = x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return x.join(y, "doc_id").select("doc_id", F.round(token_recall(F.col("w"), F.col("v")), 6).alias("recall"))


@reg("fn29_ocr_quality", "SELECT event_id, greatest(0.0, least(100.0, 100 * (value / 100) - CASE WHEN event_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 15 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 10 ELSE 0 END + 5 * (event_id % 3))) AS score FROM events")
def fn29(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", g.ocr_quality(F.col("value") / 100, e % 2 == 0, e % 5 == 0, e % 7 == 0, e % 3).alias("score"))


@reg("fn32_page_tier", "WITH x AS (SELECT doc_id, length(text) AS n, doc_id % 4 AS images, (doc_id % 10) / 20.0 AS short FROM documents) SELECT doc_id, CASE WHEN n >= 100 AND short <= 0.3 THEN 'NATIVE' WHEN images > 1 THEN 'SCAN_COMPLEX' ELSE 'SCAN_SIMPLE' END AS tier FROM x")
def fn32(spark, d):
    return table(spark, d, "documents").select("doc_id", g.page_tier(F.length("text"), F.col("doc_id") % 4, (F.col("doc_id") % 10) / 20.0).alias("tier"))


@reg("fn31_document_tier", "WITH c AS (SELECT conv_id, avg(length(text)) AS chars, avg(CASE WHEN length(text) >= 200 THEN 1.0 ELSE 0 END) AS share FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN chars >= 100 AND share >= 0.5 THEN 'NATIVE' ELSE 'SCAN' END AS tier FROM c")
def fn31(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.avg(F.length("text")).alias("chars"), F.avg((F.length("text") >= 200).cast("double")).alias("share"))
    return c.select("conv_id", F.when((F.col("chars") >= 100) & (F.col("share") >= 0.5), "NATIVE").otherwise("SCAN").alias("tier"))


@reg("pf13_content_start", "WITH s AS (SELECT *, min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS st FROM conversations) SELECT conv_id, turn FROM s WHERE st IS NULL OR turn >= st")
def pf13(spark, d):
    return g.from_content(table(spark, d, "conversations"), "conv_id", "turn", "role", "^assistant$").select("conv_id", "turn")


@reg("ch8_anchor_chunks", "SELECT conv_id, count(*) AS n FROM (SELECT conv_id, unnest(range(0, CASE WHEN length(t) > 300 THEN CAST(ceil(length(t) / 200.0) AS BIGINT) ELSE 1 END)) FROM (SELECT conv_id, text AS t FROM conversations WHERE trim(text) <> '')) GROUP BY 1")
def ch8(spark, d):
    c = table(spark, d, "conversations")
    return g.anchored_chunks(c, "conv_id", "text", "^Điều [0-9]", 300, 200).groupBy("conv_id").agg(F.count("*").alias("n"))


@reg("mx1_document_delete", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src2')")
def mx1(spark, d):
    gone = table(spark, d, "documents").filter("source = 'src2'").select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").join(gone, "vec_id", "left_anti").select("vec_id")


@reg("mx2_relation_synonyms", "SELECT event_type, CASE event_type WHEN 'click' THEN 'REPLACES' WHEN 'view' THEN 'AMENDS' END AS rel, count(*) AS n FROM events GROUP BY 1, 2")
def mx2(spark, d):
    rel = F.when(F.col("event_type").isin("click", "supersede"), "REPLACES").when(F.col("event_type").isin("view", "modify"), "AMENDS")
    return table(spark, d, "events").select("event_type", rel.alias("rel")).groupBy("event_type", "rel").agg(F.count("*").alias("n"))


@reg("mx3_security_gate", "SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 2)")
def mx3(spark, d):
    s = F.element_at(F.array(F.lit("NON_STATUTORY"), F.lit("NO_SOURCE"), F.lit("VERIFIED"), F.lit("TAMPERED")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").withColumn("s", s).filter(F.col("s").isin("VERIFIED", "NON_STATUTORY")).select("doc_id")


@reg("mx16_scanned_ratio", "SELECT round(avg(CASE WHEN length(text) < 100 THEN 1.0 ELSE 0 END), 6) AS scanned, count(*) AS n FROM conversations WHERE turn < 3")
def mx16(spark, d):
    c = table(spark, d, "conversations").filter("turn < 3")
    return c.agg(F.round(F.avg((F.length("text") < 100).cast("double")), 6).alias("scanned"), F.count("*").alias("n"))


@reg("mx20_status_repair", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def mx20(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").join(o.filter("o_orderstatus = 'O'").select("o_custkey"), "o_custkey", "left_semi").select("o_custkey").distinct()


@reg("mx41_rerank_failure", "SELECT user_id, bool_and(value < 40 AND k = n) AS failed FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY 1")
def mx41(spark, d):
    """All scores low and all rows in their first order: the scorer did nothing."""
    from pyspark.sql import Window as W

    n = lambda *o: F.row_number().over(W.partitionBy("user_id").orderBy(*o))
    x = table(spark, d, "events").select("user_id", "value", n("event_id").alias("k"), n("ts", "event_id").alias("n"))
    return x.groupBy("user_id").agg(F.bool_and((F.col("value") < 40) & (F.col("k") == F.col("n"))).alias("failed"))


@reg("mx30_best_of_two", "SELECT l_orderkey, max_by(l_suppkey, (l_quantity, l_extendedprice)) AS best FROM lineitem GROUP BY 1")
def mx30(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_suppkey", F.struct("l_quantity", "l_extendedprice")).alias("best"))


@reg("st7_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def st7(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id")).distinct()


@reg("st6_union_all", "SELECT 'doc' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'page', count(*) FROM pages")
def st6(spark, d):
    one = lambda n, k: table(spark, d, n).agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return one("documents", "doc").unionByName(one("pages", "page"))


@reg("sk6_version_update", """WITH e AS (SELECT o_orderkey + 1 AS src, CASE WHEN o_orderkey % 10 = 0 THEN 'SUPERSEDES' ELSE 'AMENDS' END AS rel, o_orderkey AS dst FROM orders WHERE o_orderkey % 10 IN (0, 5) UNION ALL SELECT o_orderkey + 2, 'AMENDS', o_orderkey FROM orders WHERE o_orderkey % 20 = 0)
 SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 10 = 0 THEN 'SUPERSEDED' WHEN o_orderkey % 10 = 5 THEN 'OUTDATED' ELSE 'ACTIVE' END AS value FROM orders UNION ALL SELECT src || '>' || rel || '>' || dst, rel FROM e""")
def sk6(spark, d):
    """New versions supersede or amend documents, twice over: status and edges as they are then.
    What is superseded stays so when it is amended later."""
    o = table(spark, d, "orders").select("o_orderkey")
    status = KeyedStore(spark, scratch_dir(spark), "id", "id long, status string")
    edges = KeyedStore(spark, scratch_dir(spark), "key", "key string, src long, rel string, dst long")
    status.create(o.select(F.col("o_orderkey").alias("id"), F.lit("ACTIVE").alias("status")))
    edges.create(spark.createDataFrame([], edges.schema))
    key, none = F.col("o_orderkey"), F.lit(None).cast("long")
    told = o.select((key + 1).alias("new"), F.when(key % 10 == 0, key).otherwise(none).alias("supersedes"), F.when(key % 10 == 5, key).otherwise(none).alias("amends"))
    later = o.filter("o_orderkey % 20 = 0").select((key + 2).alias("new"), none.alias("supersedes"), key.alias("amends"))
    for versions in (told, later, told, later):
        g.version_update(status, edges, versions.filter("supersedes IS NOT NULL OR amends IS NOT NULL"))
    return status.read().select(F.col("id").cast("string").alias("key"), F.col("status").alias("value")).unionByName(edges.read().select("key", F.col("rel").alias("value")))
