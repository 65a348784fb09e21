"""Chunking, content starts and summaries over all documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.operators import chunk_udtf
from lexiquarry.operators import chunking as k
from lexiquarry.plans.planted import planted, planted_sql, quoted
from lexiquarry.plans.registry import Registry

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

KINDS = ["Điều 1. Phạm vi điều chỉnh của quy định này là nhà ở\nĐiều 2. Đối tượng áp dụng là mọi công trình\nx", "1.1 Phạm vi của quy chuẩn áp dụng cho nhà\n1.2 Đối tượng của quy chuẩn\nnhỏ", "Chương 1 quy định chung cho mọi công trình\nMục 2 kỹ thuật", "Name: some one of the house\nStreet: a long road by the sea\nTown: here", "only prose"]


def _cut(marker: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace(text, {quoted(marker)}, chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def _count(marker: str) -> str:
    return f"len(regexp_extract_all(text, {quoted(marker)}))"


_PARAS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_KIND = f"CASE WHEN {_count(k.ARTICLE)} >= 1 AND len({_cut(k.ARTICLE)}) > 0 THEN 'article' WHEN {_count(k.NUMBERED)} >= 2 THEN 'numbered' WHEN {_count(k.SECTION)} >= 1 THEN 'section' WHEN {_count(k.FIELD)} >= 3 THEN 'form' ELSE 'fallback' END"
_CHUNKS = f"CASE strategy WHEN 'article' THEN {_cut(k.ARTICLE)} WHEN 'numbered' THEN {_cut(k.NUMBERED)} WHEN 'section' THEN {_cut(k.SECTION)} WHEN 'form' THEN {_cut(k.FIELD)} ELSE {_PARAS} END"
_CHAIN = f"SELECT key, strategy, CASE WHEN len(list_filter(c, lambda x: length(x) >= 40)) > 0 THEN list_filter(c, lambda x: length(x) >= 40) ELSE c END AS c FROM (SELECT key, strategy, {_CHUNKS} AS c FROM (SELECT key, text, {_KIND} AS strategy FROM {{source}}))"


@reg("ch1_strategy_chain", f"SELECT key AS doc_id, strategy, len(c) AS n, md5(array_to_string(c, chr(1))) AS h FROM ({_CHAIN.replace('{source}', '(SELECT doc_id AS key, text FROM ' + planted_sql(KINDS) + ')')}) WHERE len(c) > 0")
def ch1(spark, d):
    c = k.chain_chunks(planted(spark, d, KINDS), "doc_id", "text")
    each = F.array_sort(F.collect_list(F.struct("n", "chunk")))
    return c.groupBy("doc_id", "strategy").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(each, lambda x: x["chunk"]), "\u0001").cast("binary")).alias("h"))


reg("ch1_chunk_udtf", ORACLES["ch1_strategy_chain"])(lambda spark, d: _by_udtf(spark, d))


def _by_udtf(spark, d):
    """The chain as a table function, called from SQL."""
    chunk_udtf.register(spark)
    c = spark.sql("SELECT doc_id, c.strategy, c.n, c.chunk FROM {docs}, LATERAL chunk_text(text) c", docs=planted(spark, d, KINDS).select("doc_id", "text"))
    each = F.array_sort(F.collect_list(F.struct("n", "chunk")))
    return c.groupBy("doc_id", "strategy").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(each, lambda x: x["chunk"]), "\u0001").cast("binary")).alias("h"))


_TURNS = planted_sql(["Điều 1. Phạm vi\nĐiều 2. Đối tượng", "| a | b |\n| 1 | 2 |", "short turn", "| x | y |\n| 3 | 4 |", "words of a turn"], "conversations", ("conv_id", "turn"))
_MERGE = """list_reduce([{'done': [], 'buf': ''}] || list_transform(t, lambda x: {'done': [], 'buf': x}), lambda a, x: {'done': CASE WHEN length(a.buf) >= 300 THEN list_append(a.done, a.buf) ELSE a.done END, 'buf': CASE WHEN a.buf = '' OR length(a.buf) >= 300 THEN x.buf ELSE a.buf || chr(10) || x.buf END})"""
_BLOCKS = "CASE WHEN m.buf = '' THEN m.done WHEN len(m.done) > 0 AND length(m.buf) < 150 THEN list_append(m.done[1:len(m.done) - 1], m.done[len(m.done)] || chr(10) || m.buf) ELSE list_append(m.done, m.buf) END"


@reg("ch2_layout_aware", f"""WITH s AS (SELECT conv_id, turn, trim(text) AS t, turn % 5 IN (1, 3) AS is_table FROM {_TURNS}), p AS (SELECT conv_id, coalesce(list(t ORDER BY turn) FILTER (NOT is_table AND t <> ''), []) AS t, coalesce(list(t ORDER BY turn) FILTER (is_table AND t <> ''), []) AS tables FROM s GROUP BY 1),
 w AS (SELECT *, array_to_string(t, chr(10)) AS text, {_MERGE.replace("[{'done': [], 'buf': ''}]", "[{'done': CAST([] AS VARCHAR[]), 'buf': ''}]").replace("{'done': [], 'buf': x}", "{'done': CAST([] AS VARCHAR[]), 'buf': x}")} AS m FROM p),
 b AS (SELECT conv_id, tables, CASE WHEN length(text) > 80 AND {_count(k.ARTICLE)} >= 1 THEN {_cut(k.ARTICLE)} WHEN length(text) > 200 AND {_count(k.SECTION)} >= 1 THEN {_cut(k.SECTION)} ELSE {_BLOCKS} END AS c FROM w)
 SELECT conv_id, 'text' AS kind, len(c) AS n, md5(array_to_string(c, chr(1))) AS h FROM b WHERE len(c) > 0 UNION ALL SELECT conv_id, 'table', len(tables), md5(array_to_string(tables, chr(1))) FROM b WHERE len(tables) > 0""")
def ch2(spark, d):
    turns = planted(spark, d, ["Điều 1. Phạm vi\nĐiều 2. Đối tượng", "| a | b |\n| 1 | 2 |", "short turn", "| x | y |\n| 3 | 4 |", "words of a turn"], "conversations", ("conv_id", "turn"))
    c = k.layout_chunks(turns, "conv_id", "turn", "text", (F.col("turn") % 5).isin(1, 3))
    each = F.array_sort(F.collect_list(F.struct("n", "chunk")))
    return c.groupBy("conv_id", "kind").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(each, lambda x: x["chunk"]), "\u0001").cast("binary")).alias("h"))


@reg("ch9_rechunk_export", f"""WITH m AS (SELECT conv_id AS key, string_agg(regexp_replace(text, '^\\[[^\\]\\n]*\\]\\s*', ''), chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, turn, '[' || conv_id || '] ' || text AS text FROM {_TURNS}) GROUP BY 1), c AS ({_CHAIN.replace('{source}', 'm')}), u AS (SELECT key, strategy, unnest(c) AS chunk FROM c)
 SELECT key AS conv_id, strategy, count(*) AS n, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM u WHERE length(chunk) >= 100 GROUP BY 1, 2""")
def ch9(spark, d):
    turns = planted(spark, d, ["Điều 1. Phạm vi\nĐiều 2. Đối tượng", "| a | b |\n| 1 | 2 |", "short turn", "| x | y |\n| 3 | 4 |", "words of a turn"], "conversations", ("conv_id", "turn"))
    c = k.rechunked(turns.withColumn("text", F.concat(F.lit("["), F.col("conv_id").cast("string"), F.lit("] "), F.col("text"))), "conv_id", "turn", "text")
    return c.groupBy("conv_id", "strategy").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("chars"))


@reg("ch10_table_summaries", "SELECT doc_id, 'parent' AS chunk_type, md5(text) AS h FROM documents UNION ALL SELECT doc_id, 'table_summary', md5('[TABLE SUMMARY] ' || substr(text, 1, 60)) FROM documents WHERE source = (SELECT min(source) FROM documents) AND length(text) >= 2000")
def ch10(spark, d):
    from lexiquarry.session import table

    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    first = docs.agg(F.min("source").alias("first"))
    marked = docs.join(F.broadcast(first)).withColumn("is_table", F.coalesce(F.col("source") == F.col("first"), F.lit(False))).drop("first")
    out = k.with_table_summaries(marked, "text", F.col("is_table"), lambda c: F.substring(c, 1, 60))
    return out.select("doc_id", "chunk_type", F.md5(F.col("text").cast("binary")).alias("h"))


PAGES = ["Thông tư số 12/2020/TT-BXD về nhà", "MỤC LỤC\n1.1 a 3\nQCVN 06:2022/BXD", "Lời nói đầu\nvăn bản", "TCVN 7336:2021 trang", "plain page", "plain page two", "Quyết định số 9/2021/QĐ-UBND"]
_PAGES = planted_sql(PAGES, "conversations", ("conv_id", "turn"))
_ANY = "|".join(k.STANDARDS)


@reg("cl7_standard_detection", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM {_PAGES}), s AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS scan FROM r WHERE i <= 8 GROUP BY 1)
 SELECT conv_id, trim(coalesce({', '.join(f"nullif(regexp_extract(scan, {quoted('(?i)' + p)}), '')" for p in k.STANDARDS)})) AS standard FROM s""")
def cl7(spark, d):
    return k.detected_standard(planted(spark, d, PAGES, "conversations", ("conv_id", "turn")), "conv_id", "turn", "text")


@reg("cl8_content_start", f"""WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, regexp_matches(text, {quoted('(?i)' + k.ISSUING)}) AS issuing, regexp_matches(text, {quoted('(?i)' + k.CONTENT)}) AS content, contains(text, 'MỤC LỤC') AS toc, regexp_matches(text, {quoted('(?i)' + _ANY)}) AS names FROM {_PAGES}),
 l AS (SELECT *, coalesce(max(CASE WHEN issuing AND i < 8 THEN i END) OVER (PARTITION BY conv_id), -1) AS last_ FROM p)
 SELECT conv_id, CAST(coalesce(min(CASE WHEN i > last_ AND content AND NOT toc THEN i END), min(CASE WHEN i >= greatest(last_, 0) AND names AND NOT issuing THEN i END), 0) AS BIGINT) AS start FROM l GROUP BY 1""")
def cl8(spark, d):
    pages = planted(spark, d, PAGES, "conversations", ("conv_id", "turn"))
    return k.content_starts(pages, "conv_id", "turn", "text", F.contains("text", F.lit("MỤC LỤC")))


COVERS = ["cover " * 12 + "\n1. QUY ĐỊNH CHUNG\n1.1. mục con\nĐiều 1. Phạm vi", "cover " * 12 + "\nLời nói đầu\nvăn bản", "no mark", "Điều 1. too early"]
_RANK = "CASE " + " ".join(f"WHEN regexp_matches(line, {quoted('(?i)' + p)}) THEN {i}" for i, p in enumerate(k.SUMMARY_MARKS)) + " END"


@reg("fn34_summary_window", f"""WITH t AS (SELECT * FROM {planted_sql(COVERS)}), l AS (SELECT doc_id, length(text) AS size, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
 o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY n), '') AS after_ FROM l),
 m AS (SELECT doc_id, min((rank, pos)) AS m FROM (SELECT *, {_RANK} AS rank FROM o) WHERE rank IS NOT NULL AND pos >= 50 AND pos <= size * 0.6 AND NOT regexp_matches(after_, '^\\s*1\\.1\\.') GROUP BY 1),
 s AS (SELECT t.doc_id, text, CAST(coalesce(m.m[2], CASE WHEN length(text) > 4000 THEN least(3000, length(text) // 5) ELSE 0 END) AS INTEGER) AS start FROM t LEFT JOIN m USING (doc_id))
 SELECT doc_id, start, md5(substr(text, start + 1, 12000)) AS h FROM s""")
def fn34(spark, d):
    w = k.summary_windows(planted(spark, d, COVERS), "doc_id", "text")
    return w.select("doc_id", "start", F.md5(F.col("text").cast("binary")).alias("h"))
