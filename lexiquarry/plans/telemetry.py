"""Reports over the event log, and quality metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.operators import metrics as m
from lexiquarry.operators import telemetry as t
from lexiquarry.plans.registry import Registry
from lexiquarry.session import table

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

_LOG = "log AS (SELECT event_id, event_type AS model, CASE WHEN event_type <> 'error' THEN 'success' ELSE 'failure' END AS status, value AS latency, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens, user_id AS key, ts FROM events)"


def log(spark, d):
    e = table(spark, d, "events")
    tokens = F.from_json("props", "k bigint")["k"]
    return e.select("event_id", F.col("event_type").alias("model"), F.when(F.col("event_type") != "error", "success").otherwise("failure").alias("status"), F.col("value").alias("latency"), tokens.alias("tokens"), F.col("user_id").alias("key"), "ts")


@reg("ag1_count_by_status", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def ag1(spark, d):
    return t.counts_by(table(spark, d, "orders"), "o_orderstatus")


@reg("ag2_model_telemetry", f"WITH {_LOG} SELECT model, count(*) AS requests, round(100.0 * count(*) FILTER (status = 'success') / count(*), 6) AS success_pct, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(latency), 6) AS avg_latency, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.9), 6) AS p90, round(quantile_cont(latency, 0.99), 6) AS p99 FROM log WHERE model ILIKE '%e%' GROUP BY 1")
def ag2(spark, d):
    rep = t.model_report(log(spark, d).filter(F.col("model").ilike("%e%")))
    return rep.select("model", "requests", "tokens", *[F.round(c, 6).alias(c) for c in ("success_pct", "avg_latency", "p50", "p90", "p99")])


@reg("ag3_daily_trend", f"WITH {_LOG} SELECT CAST(ts AS DATE) AS day, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, count(DISTINCT key) AS keys FROM log GROUP BY 1")
def ag3(spark, d):
    return t.daily_trend(log(spark, d))


@reg("ag4_summary_top_models", f"WITH {_LOG} SELECT 'TOTAL' AS model, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM log UNION ALL (SELECT model, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4)")
def ag4(spark, d):
    return t.summary_and_top(log(spark, d))


@reg("ag5_digest_top3", f"WITH {_LOG} SELECT regexp_replace('vendor/' || model, '^[^/]*/', '') AS model, count(*) AS n FROM log WHERE ts >= (SELECT max(ts) FROM log) - INTERVAL 1 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def ag5(spark, d):
    x = log(spark, d)
    last = x.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("since"))
    y = x.join(F.broadcast(last)).filter("ts >= since").withColumn("model", F.regexp_replace(F.concat(F.lit("vendor/"), "model"), "^[^/]*/", ""))
    return t.counts_by(y, "model").orderBy(F.desc("n"), "model").limit(3)


@reg("ag6_rate_and_eta", "SELECT count(*) FILTER (o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2001-01-01') / 5.0 AS rate, count(*) FILTER (o_orderstatus IN ('P', 'O')) AS \"left\", round(count(*) FILTER (o_orderstatus IN ('P', 'O')) / nullif(count(*) FILTER (o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2001-01-01') / 5.0, 0), 6) AS eta_minutes FROM orders")
def ag6(spark, d):
    o = table(spark, d, "orders").withColumn("st", F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "PENDING").otherwise("CLAIMED"))
    return t.rate_and_eta(o, "st", F.col("o_orderdate") >= "2001-01-01").withColumn("eta_minutes", F.round("eta_minutes", 6))


@reg("ag17_edge_histogram", "SELECT event_type AS rel, count(*) AS n FROM events GROUP BY 1")
def ag17(spark, d):
    return t.counts_by(table(spark, d, "events").withColumnRenamed("event_type", "rel"), "rel")


@reg("ag18_dashboard_totals", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM events) AS edges, (SELECT count(*) FROM embeddings) AS vectors")
def ag18(spark, d):
    one = lambda x, c: table(spark, d, x).agg(F.count("*").alias(c))
    return one("documents", "documents").join(one("events", "edges")).join(one("embeddings", "vectors"))


@reg("ag20_cache_statistics", "SELECT count(*) FILTER (value > 50) AS hits, count(*) FILTER (NOT value > 50) AS misses, round(100.0 * count(*) FILTER (value > 50) / count(*), 6) AS hit_pct FROM events")
def ag20(spark, d):
    return t.hit_rate(table(spark, d, "events"), F.col("value") > 50).withColumn("hit_pct", F.round("hit_pct", 6))


_BOUNDS = [5.0, 10.0, 25.0, 50.0, 75.0, 100.0]


@reg("ag21_latency_buckets", " UNION ALL ".join(f"SELECT event_type, CAST({b} AS DOUBLE) AS le, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY 1" for b in _BOUNDS) + " UNION ALL SELECT event_type, CAST('infinity' AS DOUBLE) AS le, count(*) AS n FROM events GROUP BY 1")
def ag21(spark, d):
    return t.cumulative_buckets(table(spark, d, "events"), "value", _BOUNDS, "event_type")


_B = "b AS (" + " UNION ALL ".join(f"SELECT event_type, CAST({b} AS DOUBLE) AS le, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY 1" for b in _BOUNDS) + " UNION ALL SELECT event_type, CAST('infinity' AS DOUBLE) AS le, count(*) AS n FROM events GROUP BY 1)"


@reg("ss16_histogram_quantile", f"WITH {_B}, x AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY le), 0) AS below, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0) AS lower, max(n) OVER (PARTITION BY event_type) AS total FROM b) SELECT event_type, round(CASE WHEN isinf(le) THEN lower ELSE lower + (le - lower) * (0.9 * total - below) / (n - below) END, 6) AS quantile FROM x WHERE n >= 0.9 * total AND below < 0.9 * total")
def ss16(spark, d):
    b = t.cumulative_buckets(table(spark, d, "events"), "value", _BOUNDS, "event_type")
    return t.histogram_quantile(b, 0.9, "event_type").withColumn("quantile", F.round("quantile", 6))


@reg("ss15_counter_rate", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) FILTER (event_type = 'error') AS bad, count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS share FROM events GROUP BY 1")
def ss15(spark, d):
    return t.windowed_rate(table(spark, d, "events"), "ts", "1 hour", "1 hour", F.col("event_type") == "error").withColumn("share", F.round("share", 6))


@reg("ss17_group_rate", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) FILTER (value > 50) AS bad, count(*) AS n, round(count(*) FILTER (value > 50) / count(*), 6) AS share FROM events GROUP BY 1, 2")
def ss17(spark, d):
    return t.windowed_rate(table(spark, d, "events"), "ts", "1 day", "1 day", F.col("value") > 50, "event_type").withColumn("share", F.round("share", 6))


@reg("ss18_topk_series", "SELECT user_id, round(max_by(value, (ts, event_id)), 6) AS latest FROM events GROUP BY 1 ORDER BY max_by(value, (ts, event_id)) DESC, 1 LIMIT 5")
def ss18(spark, d):
    return t.latest_top(table(spark, d, "events"), "user_id", "value", "ts", "event_id", 5).withColumn("latest", F.round("latest", 6))


_HOLDS = "h AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, user_id % 4 AS grp, count(*) FILTER (event_type = 'error') AS bad, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT * FROM h WHERE bad >= 1 AND n > 2)"


@reg("ss19_conjunctive_alert", f"WITH {_HOLDS}, g AS (SELECT *, epoch(start) - 21600 * row_number() OVER (PARTITION BY grp ORDER BY start) AS run FROM r), l AS (SELECT start, grp, bad, n, row_number() OVER (PARTITION BY grp, run ORDER BY start) AS len FROM g) SELECT * FROM l WHERE len >= 2")
def ss19(spark, d):
    e = table(spark, d, "events").withColumn("grp", F.col("user_id") % 4)
    w = t.windowed_rate(e, "ts", "6 hours", "6 hours", F.col("event_type") == "error", "grp").drop("share")
    return t.sustained(w, (F.col("bad") >= 1) & (F.col("n") > 2), 2, 21600, "grp")


@reg("ss11_fixed_window_quota", "WITH f AS (SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events) SELECT user_id, CAST(floor((epoch_us(ts) - epoch_us(t0)) / 86400000000.0) AS BIGINT) AS window_no, count(*) AS n, count(*) < 0.95 * 4 AS safe FROM f GROUP BY 1, 2")
def ss11(spark, d):
    return t.fixed_window_quota(table(spark, d, "events"), "user_id", "ts", 24, 4)


@reg("sk15_retention_archive", "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def sk15(spark, d):
    e = table(spark, d, "events")
    cut = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAY")).alias("cut"))
    return t.expired(e.join(F.broadcast(cut)), "ts", F.col("cut")).select("event_id")


@reg("sk16_retention_prune", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def sk16(spark, d):
    e = table(spark, d, "events")
    cut = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAY")).alias("cut"))
    return t.retained(e.join(F.broadcast(cut)), "ts", F.col("cut")).select("event_id")


@reg("sk17_health_prune", "SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY")
def sk17(spark, d):
    o = table(spark, d, "orders")
    cut = o.agg((F.max("o_orderdate") - F.expr("INTERVAL 30 DAY")).alias("cut"))
    return t.retained(o.join(F.broadcast(cut)), "o_orderdate", F.col("cut")).select("o_orderkey")


_ITEMS = """c AS (SELECT o_custkey % 200 AS q, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders),
 i AS (SELECT q, list(o_orderkey ORDER BY k) FILTER (k <= 5) AS ret, list_sort(list(o_orderkey) FILTER (o_orderkey % 7 = 0 AND k <= 10)) AS e FROM c GROUP BY q),
 items AS (SELECT q, CASE q % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'comparison' ELSE 'timeline' END AS category, CASE WHEN q % 17 = 0 THEN 'oom' END AS error, CAST(q * 37 % 1000 AS DOUBLE) AS latency, ret, coalesce(e, []) AS exp FROM i),
 s AS (SELECT *, CASE WHEN len(exp) = 0 THEN 1.0 ELSE len(list_intersect(ret[1:1], exp)) / len(exp) END AS r1, CASE WHEN len(exp) = 0 THEN 1.0 ELSE len(list_intersect(ret[1:3], exp)) / len(exp) END AS r3,
  CASE WHEN len(exp) = 0 THEN 1.0 ELSE len(list_intersect(ret[1:5], exp)) / len(exp) END AS r5, len(list_filter(ret[1:5], lambda x: list_contains(exp, x))) / 5.0 AS p5,
  CASE WHEN len(exp) = 0 THEN 1.0 ELSE coalesce(1.0 / list_min(list_filter(list_transform(range(1, len(ret) + 1), lambda j: CASE WHEN list_contains(exp, ret[j]) THEN j END), lambda z: z IS NOT NULL)), 0.0) END AS mrr FROM items)"""


def items(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").withColumn("q", F.col("o_custkey") % 200)
    o = o.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    ret = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "o_orderkey")))), lambda x: x["o_orderkey"])
    g = o.groupBy("q").agg(ret.alias("ret"), F.array_sort(F.collect_list(F.when((F.col("o_orderkey") % 7 == 0) & (F.col("k") <= 10), F.col("o_orderkey")))).alias("exp"))
    g = g.withColumns({"category": F.when(F.col("q") % 3 == 0, "semantic").when(F.col("q") % 3 == 1, "comparison").otherwise("timeline"), "error": F.when(F.col("q") % 17 == 0, "oom"), "latency": (F.col("q") * 37 % 1000).cast("double")})
    g = g.withColumns({f"r{k}": m.recall_at("ret", "exp", k) for k in (1, 3, 5)})
    return g.withColumns({"p5": m.precision_at("ret", "exp", 5), "mrr": m.reciprocal_rank("ret", "exp")})


@reg("st2_recall_at_k", f"WITH {_ITEMS} SELECT q, round(r1, 6) AS r1, round(r3, 6) AS r3, round(r5, 6) AS r5 FROM s")
def st2(spark, d):
    return items(spark, d).select("q", *[F.round(c, 6).alias(c) for c in ("r1", "r3", "r5")])


@reg("st3_mrr", f"WITH {_ITEMS} SELECT q, round(mrr, 6) AS mrr, round(p5, 6) AS p5 FROM s")
def st3(spark, d):
    return items(spark, d).select("q", F.round("mrr", 6).alias("mrr"), F.round("p5", 6).alias("p5"))


_MEANS = "count(*) AS total, count(*) FILTER (error IS NOT NULL) AS failed, " + ", ".join(f"round(avg({c}) FILTER (error IS NULL), 6) AS {c}" for c in ("r1", "r3", "r5", "p5", "mrr")) + ", round(avg(latency) FILTER (error IS NULL), 6) AS avg_latency, list_sort(list(latency) FILTER (error IS NULL))[CAST(least(floor(0.95 * count(*) FILTER (error IS NULL)), count(*) FILTER (error IS NULL) - 1) AS INTEGER) + 1] AS p95_latency"
_ROUNDED = ("r1", "r3", "r5", "p5", "mrr", "avg_latency")


@reg("ag7_retrieval_metrics", f"WITH {_ITEMS} SELECT {_MEANS} FROM s")
def ag7(spark, d):
    return m.metric_means(items(spark, d)).withColumns({c: F.round(c, 6) for c in _ROUNDED})


@reg("ag8_category_breakdown", f"WITH {_ITEMS} SELECT category, {_MEANS} FROM s GROUP BY ROLLUP (category)")
def ag8(spark, d):
    return m.metric_means(items(spark, d), "category").withColumns({c: F.round(c, 6) for c in _ROUNDED})


@reg("ag9_gold_scorecard", "SELECT coalesce(event_type, 'overall') AS category, count(*) FILTER (value > 30) AS passed, count(*) AS total, round(100.0 * count(*) FILTER (value > 30) / count(*), 6) AS pct FROM events GROUP BY ROLLUP (event_type)")
def ag9(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("category"), (F.col("value") > 30).alias("passed"))
    return m.scorecard(e).withColumn("pct", F.round("pct", 6))


@reg("ag15_page_gaps", "WITH g AS (SELECT l_orderkey, list_filter(range(CAST(min(l_linenumber) AS BIGINT), CAST(max(l_linenumber) AS BIGINT) + 1), lambda x: NOT list_contains(list(l_linenumber), x)) AS gap FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(len(gap) AS INTEGER) AS n_gaps, CAST(list_min(gap) AS INTEGER) AS first_gap, CAST(list_max(gap) AS INTEGER) AS last_gap FROM g WHERE len(gap) > 0")
def ag15(spark, d):
    return m.missing_in_range(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@reg("fn24_linear_score", "SELECT event_id, CAST(greatest(0, trunc(100.0 - value / 60.0 * 100.0)) AS INTEGER) AS score FROM events")
def fn24(spark, d):
    return table(spark, d, "events").select("event_id", m.linear_score(F.col("value") / 60.0).alias("score"))


@reg("fn25_percent_text", "SELECT event_type, printf('%.1f%%', 100.0 * count(*) FILTER (value > 30) / greatest(count(*), 1)) AS pct FROM events GROUP BY 1")
def fn25(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(m.percent_text(F.count_if(F.col("value") > 30), F.count("*")).alias("pct"))


@reg("fn26_spacing_ratio", "SELECT doc_id, round((length(text) - length(replace(text, ' ', ''))) / (length(text) + 1.0), 6) AS ratio FROM documents")
def fn26(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(m.spacing_ratio("text"), 6).alias("ratio"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: length(w) >= {1}))"


@reg("st4_answer_completeness", f"""WITH b AS (SELECT item_id, {_WORDS.format('text', 3)} AS bw FROM benchmark WHERE item_id % 20 = 0), d AS (SELECT doc_id, {_WORDS.format('text', 3)} AS dw FROM documents),
 s AS (SELECT item_id, doc_id, round(CASE WHEN len(bw) = 0 THEN 1.0 ELSE len(list_intersect(dw, bw)) / len(bw) END, 6) AS share FROM b, d)
 SELECT item_id, doc_id, share, row_number() OVER (PARTITION BY item_id ORDER BY share DESC, doc_id) AS rank FROM s WHERE share > 0 QUALIFY rank <= 10""")
def st4(spark, d):
    """For every 20th item the ten documents that cover most of its words, of all documents."""
    b = table(spark, d, "benchmark").filter("item_id % 20 = 0").select("item_id", m.words_of(F.col("text"), 3).alias("bw"))
    x = table(spark, d, "documents").select("doc_id", m.words_of(F.col("text"), 3).alias("dw"))
    return m.best_covered(b, x, "item_id", "doc_id", 10).select("item_id", "doc_id", "share", "rank")


@reg("st1_section_coverage", f"WITH a AS (SELECT doc_id, {_WORDS.format('text', 4)} AS w FROM documents) SELECT x.doc_id, round(CASE WHEN len(y.w) = 0 THEN 1.0 ELSE len(list_intersect(x.w, y.w)) / len(y.w) END, 6) AS coverage, CASE WHEN len(y.w) = 0 THEN 1.0 ELSE len(list_intersect(x.w, y.w)) / len(y.w) END >= 0.5 AS accepted FROM a x JOIN a y ON y.doc_id = x.doc_id + 1")
def st1(spark, d):
    # Each document's words go to itself and to the one before, in one exchange by id.
    a = table(spark, d, "documents").select("doc_id", m.words_of(F.col("text"), 4).alias("w"))
    two = F.array(F.struct(F.col("doc_id").alias("at"), F.lit(True).alias("own")), F.struct((F.col("doc_id") - 1).alias("at"), F.lit(False).alias("own")))
    met = a.select(F.explode(two).alias("x"), "w").groupBy("x.at").agg(F.first(F.when(F.col("x.own"), F.col("w")), ignorenulls=True).alias("w"), F.first(F.when(~F.col("x.own"), F.col("w")), ignorenulls=True).alias("v"))
    share = m.overlap_share(F.col("w"), F.col("v"))
    return met.filter("w IS NOT NULL AND v IS NOT NULL").select(F.col("at").alias("doc_id"), F.round(share, 6).alias("coverage"), (share >= 0.5).alias("accepted"))


@reg("st5_relations_union", "SELECT user_id, list_sort(list_distinct(list_concat(coalesce(list(event_type) FILTER (value > 50), []), coalesce(list(event_type) FILTER (event_id % 2 = 0), [])))) AS rels FROM events GROUP BY 1")
def st5(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("b"))
    return g.select("user_id", F.array_sort(F.array_union("a", "b")).alias("rels"))


@reg("wn19_even_page_sample", "WITH p AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS a FROM conversations), q AS (SELECT *, greatest(2, least(5, floor(0.3 * total))) AS n FROM p), s AS (SELECT *, greatest(1, floor((total - 1) / n)) AS st FROM q) SELECT conv_id, turn FROM s WHERE a >= 1 AND (a - 1) % st = 0 AND floor((a - 1) / st) < n")
def wn19(spark, d):
    return m.even_sample(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn")


@reg("wn23_grid_argmax", "SELECT n.n_nationkey, r.r_regionkey, CAST(-(pow(n.n_nationkey - 7, 2) + pow(r.r_regionkey - 3, 2)) AS DOUBLE) AS score FROM nation n, region r ORDER BY score DESC, 1, 2 LIMIT 1")
def wn23(spark, d):
    score = -(F.pow(F.col("n_nationkey") - 7, F.lit(2)) + F.pow(F.col("r_regionkey") - 3, F.lit(2)))
    return m.grid_argmax({"n_nationkey": table(spark, d, "nation"), "r_regionkey": table(spark, d, "region")}, score)
