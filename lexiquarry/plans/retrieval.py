"""Retrieval queries over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.operators import inverted_index, number_line, vector_index
from lexiquarry.operators import retrieval as r
from lexiquarry.plans.registry import Registry
from lexiquarry.session import table
from lexiquarry.sources.index_store import stored_index

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

#: Queries are the rows whose id 20 divides, against all rows; a row is no answer to itself.
_COS = """
 e AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings),
 dense AS (SELECT a.vec_id AS q_id, b.vec_id, b.label, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (a.n * b.n), 9) AS score
   FROM e a JOIN e b ON a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id)"""
_SPARSE = """
 w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
 qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY 1, 2),
 sparse AS (SELECT item_id, doc_id, CAST(sum(tf * qtf) AS DOUBLE) AS score FROM tf JOIN qt USING (term) GROUP BY 1, 2)"""


def _best(source: str, k: int, q: str, key: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {q} ORDER BY score DESC, {key}) AS rank FROM {source} QUALIFY rank <= {k}"


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    one = F.lit(0).alias("filter_key")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), one, F.col("embedding").alias("q_vec"))
    return q, e.select(F.col("vec_id").alias("c_id"), one, F.col("embedding").alias("c_vec"))


def dense(spark, d, k, least=-2.0):
    """(q_id, vec_id, score, rank) of the k nearest rows."""
    return r.nearest(*_vectors(spark, d), k, least).select("q_id", F.col("c_id").alias("vec_id"), F.col("sim").alias("score"), "rank")


def text_index(spark, d):
    """The inverted index of the documents' words."""
    def build(path):
        tf = r.term_frequencies(table(spark, d, "documents"), "doc_id", "text")
        inverted_index.build(tf.select(F.col("doc_id").alias("key"), "term", F.col("tf").alias("weight")), path)

    return inverted_index.InvertedIndex(spark, stored_index(spark, "words", f"{d}/documents.parquet", build))


def items(spark, d):
    b = table(spark, d, "benchmark").filter("item_id % 20 = 0")
    return r.term_frequencies(b, "item_id", "text").select(F.col("item_id").alias("qid"), "term", F.col("tf").alias("weight"))


def sparse(spark, d, k):
    """(item_id, doc_id, score, rank) of the k best documents."""
    found = inverted_index.search(text_index(spark, d), items(spark, d), k)
    return found.select(F.col("qid").alias("item_id"), F.col("key").alias("doc_id"), "score", "rank")


@reg("vg1_l2_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n)), 6) AS total, round(CAST(embedding[1] AS DOUBLE) / n, 6) AS first FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)")
def vg1(spark, d):
    v = r.l2_normalise(table(spark, d, "embeddings"), "embedding")
    return v.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("embedding")[0], 6).alias("first"))


@reg("vg3_cosine_topk", f"WITH {_COS} SELECT q_id, vec_id, round(score, 6) AS score, rank FROM ({_best('dense', 20, 'q_id', 'vec_id')})")
def vg3(spark, d):
    return dense(spark, d, 20).select("q_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@reg("vg3_sparse_topk", f"WITH {_SPARSE} SELECT item_id, doc_id, score, rank FROM ({_best('sparse', 20, 'item_id', 'doc_id')})")
def vg3_sparse(spark, d):
    return sparse(spark, d, 20)


@reg("vg3_approximate_topk")
def vg3_approximate(spark, d):
    """The nearest rows by cells and product codes; recall against vg3_cosine_topk is tested."""
    def build(path):
        vector_index.build(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), path)

    index = vector_index.load(spark, stored_index(spark, "vectors", f"{d}/embeddings.parquet", build))
    q = table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("v"))
    return vector_index.search(index, q, 10).select("q_id", F.col("id").alias("vec_id"), F.round("sim", 6).alias("score"), "rank")


@reg("vg4_cache_similarity", f"WITH {_COS} SELECT q_id, vec_id, round(score, 6) AS score FROM ({_best('dense', 1, 'q_id', 'vec_id')}) WHERE score >= 0.3")
def vg4(spark, d):
    return dense(spark, d, 1, 0.3).select("q_id", "vec_id", F.round("score", 6).alias("score"))


_FUSED = f"""WITH {_COS}, {_SPARSE},
 dl AS (SELECT q_id, vec_id AS doc_id, rank FROM ({_best('dense', 50, 'q_id', 'vec_id')}) WHERE q_id IN (SELECT item_id FROM benchmark)),
 sl AS (SELECT item_id AS q_id, doc_id, rank FROM ({_best('sparse', 50, 'item_id', 'doc_id')})),
 fused AS (SELECT q_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS fused FROM (SELECT * FROM dl UNION ALL SELECT * FROM sl) GROUP BY 1, 2)"""


def fused(spark, d, k):
    """(q_id, doc_id, fused, rank): the k best of both lists; an item's vector is that of its id."""
    items_ = table(spark, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("q_id"))
    dl = dense(spark, d, 50).join(items_, "q_id", "left_semi").select("q_id", F.col("vec_id").alias("doc_id"), "rank")
    sl = sparse(spark, d, 50).select(F.col("item_id").alias("q_id"), "doc_id", "rank")
    both = r.reciprocal_rank_fusion([dl, sl], "q_id", "doc_id").withColumn("fused", F.round("fused", 9))
    return r.first_of_each(both, k, "q_id", "fused", "doc_id")


@reg("wn1_rrf_fusion", f"{_FUSED} SELECT q_id, doc_id, fused, row_number() OVER (PARTITION BY q_id ORDER BY fused DESC, doc_id) AS rank FROM fused QUALIFY rank <= 10")
def wn1(spark, d):
    return fused(spark, d, 10)


_HITS = f"""{_COS},
 hits AS (SELECT q_id, vec_id, score, (label % 7) / 10.0 AS rerank, label = 0 AS is_table, CASE label % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'OUTDATED' ELSE 'DRAFT' END AS status FROM ({_best('dense', 50, 'q_id', 'vec_id')}))"""


def hits(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    h = dense(spark, d, 50).join(labels, "vec_id").select("q_id", "vec_id", "label", "score", ((F.col("label") % 7) / 10.0).alias("rerank"), (F.col("label") == 0).alias("is_table"))
    return h.withColumn("status", F.when(F.col("label") % 3 == 0, "ACTIVE").when(F.col("label") % 3 == 1, "OUTDATED").otherwise("DRAFT"))


@reg("wn3_rerank_boost", f"WITH {_HITS}, f AS (SELECT q_id, vec_id, round(0.8 * rerank + 0.2 * score + CASE WHEN is_table THEN 0.2 ELSE 0 END + CASE status WHEN 'ACTIVE' THEN 0.15 WHEN 'OUTDATED' THEN -0.3 ELSE 0 END, 6) AS final FROM hits) SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY final DESC, vec_id) AS rank FROM f QUALIFY rank <= 15")
def wn3(spark, d):
    f = r.boosted(hits(spark, d)).select("q_id", "vec_id", F.round("final", 6).alias("final"))
    return r.first_of_each(f, 15, "q_id", "final", "vec_id")


@reg("flagship_hybrid_search", f"""{_FUSED}, f AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY fused DESC, doc_id) <= 30),
 s AS (SELECT f.q_id, f.doc_id, f.fused, round(0.8 * f.fused + 0.2 * d.score + CASE WHEN d.label = 0 THEN 0.2 ELSE 0 END, 6) AS final, x.lang FROM f JOIN dense d ON d.q_id = f.q_id AND d.vec_id = f.doc_id JOIN documents x ON x.doc_id = f.doc_id)
 SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY final DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def flagship(spark, d):
    """Hybrid search for all queries: both lists fused, the best 30 of each scored, the best 10 returned."""
    q, c = _vectors(spark, d)
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    pairs = fused(spark, d, 30).drop("rank").join(q.select("q_id", "q_vec"), "q_id").join(c.select(F.col("c_id").alias("doc_id"), "c_vec"), "doc_id").filter("q_id != doc_id")
    scored = pairs.withColumn("score", F.round(r.cosine("q_vec", "c_vec"), 9)).join(label, "doc_id").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    final = 0.8 * F.col("fused") + 0.2 * F.col("score") + F.when(F.col("label") == 0, 0.2).otherwise(0.0)
    return r.first_of_each(scored.select("q_id", "doc_id", "fused", F.round(final, 6).alias("final"), "lang"), 10, "q_id", "final", "doc_id")


_CHUNKS = """chunks AS (SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS chunk_id, text, source AS doc_type, lang AS authority, CASE doc_id % 5 WHEN 0 THEN 'parent' WHEN 1 THEN 'amendment' ELSE 'child' END AS chunk_type, CAST(2000 + doc_id % 20 AS VARCHAR) || '-01-02' AS doc_date, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS hop FROM documents)"""


def chunks(spark, d):
    x = table(spark, d, "documents")
    return x.select(
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("chunk_id"),
        "text",
        F.col("source").alias("doc_type"),
        F.col("lang").alias("authority"),
        F.when(F.col("doc_id") % 5 == 0, "parent").when(F.col("doc_id") % 5 == 1, "amendment").otherwise("child").alias("chunk_type"),
        F.concat((2000 + F.col("doc_id") % 20).cast("string"), F.lit("-01-02")).alias("doc_date"),
        F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("hop"),
    )


@reg("pf1_search_predicate", f"WITH {_CHUNKS} SELECT chunk_id FROM chunks WHERE authority = 'en' AND doc_date LIKE '2003%' AND chunk_type NOT IN ('amendment', 'diff_matrix', 'superseded', 'instrument')")
def pf1(spark, d):
    return r.search_filter(chunks(spark, d), authority="en", year=2003).select("chunk_id")


@reg("pf3_result_projection", f"WITH {_CHUNKS} SELECT chunk_id, doc_type, chunk_type, md5(text) AS head, false AS is_table, [0, 0, 1000, 1000] AS bbox, '' AS summary FROM chunks")
def pf3(spark, d):
    box = F.coalesce(F.from_json(F.lit("not json"), "array<int>", {"mode": "PERMISSIVE"}), F.array(*[F.lit(x) for x in (0, 0, 1000, 1000)]))
    return chunks(spark, d).select("chunk_id", "doc_type", "chunk_type", F.md5(F.col("text").cast("binary")).alias("head"), F.lit(False).alias("is_table"), box.alias("bbox"), F.lit("").alias("summary"))


@reg("wn2_hop_quota", f"WITH {_CHUNKS}, n AS (SELECT *, row_number() OVER (PARTITION BY hop ORDER BY ord) AS k FROM chunks) SELECT ord, hop FROM n WHERE (hop = 2 AND k <= 5) OR (hop = 1 AND k <= 7)")
def wn2(spark, d):
    return r.hop_quota(chunks(spark, d), 12, 5).select("ord", "hop")


@reg("wn4_hit_dedup", "SELECT min(doc_id) AS ord FROM documents GROUP BY text")
def wn4(spark, d):
    c = chunks(spark, d).withColumn("chunk_id", F.lit(""))
    return r.first_by_key(c, r.hit_key(), "ord").select("ord")


@reg("wn5_union_dedup", "SELECT min(doc_id) AS ord FROM documents WHERE text <> '' GROUP BY substr(text, 1, 200)")
def wn5(spark, d):
    c = chunks(spark, d)
    parts = c.filter("ord % 2 = 0").unionByName(c.filter("ord % 2 = 1")).filter("text != ''")
    return r.first_by_key(parts, F.substring("text", 1, 200), "ord").select("ord")


@reg("wn14_parent_text_dedup", f"WITH {_CHUNKS} SELECT min(ord) AS ord FROM chunks WHERE chunk_type = 'parent' GROUP BY trim(text)")
def wn14(spark, d):
    return r.first_by_key(chunks(spark, d).filter("chunk_type = 'parent'"), F.trim("text"), "ord").select("ord")


@reg("jn1_parent_expansion", "SELECT n_nationkey, coalesce(r_name, n_name) AS text, CASE WHEN r_name IS NOT NULL THEN n_name END AS child_text FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) r ON n_regionkey = r_regionkey")
def jn1(spark, d):
    kids = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("parent_id"), F.col("n_name").alias("text"))
    parents = table(spark, d, "region").filter("r_regionkey != 2").select(F.col("r_regionkey").alias("parent_id"), F.col("r_name").alias("text"))
    return r.expand_parents(kids, parents).select("n_nationkey", "text", "child_text")


@reg("jn2_status_lookup", "SELECT o_orderkey, CASE WHEN st = 'OUTDATED' THEN '[OUTDATED] ' || o_orderpriority ELSE o_orderpriority END AS text, coalesce(st, 'ACTIVE') AS status FROM orders LEFT JOIN (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'OUTDATED' ELSE 'ACTIVE' END AS st FROM customer WHERE c_custkey % 3 = 0) c ON o_custkey = c_custkey")
def jn2(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("text"))
    status = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.when(F.col("c_nationkey") % 2 == 0, "OUTDATED").otherwise("ACTIVE").alias("status"))
    return r.with_status(rows, status, "key").select("o_orderkey", "text", "status")


@reg("jn3_status_normalisation", "SELECT o_orderstatus AS raw, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'OUTDATED' ELSE 'ACTIVE' END AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def jn3(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderstatus").alias("raw"), F.when(F.col("o_orderstatus").isin("F", "P"), "OUTDATED").otherwise("ACTIVE").alias("status")).groupBy("raw", "status").agg(F.count("*").alias("n"))


@reg("jn9_coverage_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def jn9(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@reg("jn10_session_merge", "SELECT conv_id, turn FROM conversations WHERE turn < 2 UNION SELECT conv_id, turn FROM conversations WHERE turn >= 1")
def jn10(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    now, kept = c.filter("turn < 2"), c.filter("turn >= 1")
    return now.unionByName(kept.join(now, ["conv_id", "turn"], "left_anti")).distinct()


@reg("jn11_rerank_back_join", "SELECT conv_id, turn, i, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)")
def jn11(spark, d):
    c = table(spark, d, "conversations")
    lists = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles")).select("conv_id", F.posexplode("roles").alias("i", "role"))
    pos = c.select("conv_id", "turn", (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).alias("i"))
    return lists.join(pos, ["conv_id", "i"]).select("conv_id", "turn", F.col("i").cast("long").alias("i"), "role")


@reg("wn20_nearest_semantic_match", """WITH e AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings),
 p AS (SELECT a.vec_id AS q_id, b.vec_id AS c_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (a.n * b.n), 9) AS sim FROM e a JOIN e b ON a.label = b.label AND a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, c_id) AS r FROM p WHERE sim >= 0.2) SELECT q_id, c_id, round(sim, 6) AS sim FROM k WHERE r = 1""")
def wn20(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("label").alias("filter_key"), F.col("embedding").alias("q_vec"))
    c = e.select(F.col("vec_id").alias("c_id"), F.col("label").alias("filter_key"), F.col("embedding").alias("c_vec"))
    return r.nearest_match(q, c, 0.2).withColumn("sim", F.round("sim", 6))


@reg("wn7_decayed_context", """WITH t AS (SELECT conv_id AS session, turn, role AS item, CAST(length(text) % 97 AS DOUBLE) / 97 AS score FROM conversations),
 l AS (SELECT session, max(turn) AS last_turn FROM t GROUP BY 1), x AS (SELECT session, item, max_by(score, turn) AS score, max(turn) AS turn FROM t GROUP BY 1, 2)
 SELECT x.session, item, round(score * pow(0.8, last_turn - turn), 6) AS decayed FROM x JOIN l ON x.session = l.session""")
def wn7(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", F.col("role").alias("item"), ((F.length("text") % 97).cast("double") / 97).alias("score"))
    return r.decayed_top(t).select("session", "item", F.round("decayed", 6).alias("decayed"))


@reg("wn8_last_turns", "SELECT conv_id, turn, substr(text, 1, 2000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 20")
def wn8(spark, d):
    k = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").withColumn("k", k).filter("k <= 20").select("conv_id", "turn", F.substring("text", 1, 2000).alias("text"))


@reg("wn9_context_summary", "SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 200), chr(10) ORDER BY turn) AS summary, list_sort(list_distinct(list(role))) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6 GROUP BY conv_id")
def wn9(spark, d):
    k = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    t = table(spark, d, "conversations").withColumn("k", k).filter("k <= 6")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.substring("text", 1, 200)).alias("line"))))
    return t.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("summary"), F.array_sort(F.collect_set("role")).alias("roles"))


@reg("wn10_recent_traces", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def wn10(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts")


@reg("wn11_traces_by_session", "SELECT event_id, user_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) WHERE user_id % 10 = 3")
def wn11(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).filter("user_id % 10 = 3").select("event_id", "user_id")


@reg("wn12_previous_versions", "SELECT o_custkey, o_orderkey, k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'O') WHERE k <= 3")
def wn12(spark, d):
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return table(spark, d, "orders").filter("o_orderstatus != 'O'").withColumn("k", k).filter("k <= 3").select("o_custkey", "o_orderkey", "k")


@reg("wn13_superseded_by_top5", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def wn13(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select("o_orderkey", "o_orderdate")


@reg("wn21_nearest_label", "SELECT p_partkey, s_suppkey, round(sqrt(d2), 6) AS dist FROM (SELECT p_partkey, s_suppkey, d2, row_number() OVER (PARTITION BY p_partkey ORDER BY d2, s_suppkey) AS k FROM (SELECT p_partkey, s_suppkey, pow(p_size - s_nationkey, 2) + pow(p_retailprice / 100.0 - s_acctbal / 100.0, 2) AS d2 FROM part JOIN supplier ON abs(p_size - s_nationkey) <= 2)) WHERE k = 1")
def wn21(spark, d):
    """Parts of one size and price have one answer; it is looked up by order, not by pairs."""
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    marks = s.select(F.col("s_nationkey").alias("b"), (F.col("s_acctbal") / 100.0).alias("w"), F.col("s_suppkey").alias("key"))
    own = p.select("p_partkey", F.col("p_size").cast("long").alias("p_size"), (F.col("p_retailprice") / 100.0).alias("price"))
    best = number_line.nearest_in_band(own.select(F.col("p_size").alias("a"), F.col("price").alias("v")), marks, 2)
    met = own.join(best, (F.col("p_size") == F.col("a")) & F.col("price").eqNullSafe(F.col("v")))
    first = met.groupBy("p_partkey").agg(number_line.least("d2", "key").alias("b"))
    return first.select("p_partkey", F.col("b.key").alias("s_suppkey"), F.round(F.sqrt("b.d2"), 6).alias("dist"))


@reg("wn22_review_flags", "SELECT event_type, round(avg(value), 6) AS mean, avg(value) < 52 AS flagged FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 5 GROUP BY 1")
def wn22(spark, d):
    k = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return table(spark, d, "events").withColumn("k", k).filter("k <= 5").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), (F.avg("value") < 52).alias("flagged"))
