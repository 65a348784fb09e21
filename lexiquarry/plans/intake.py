"""Readers, hooks, page routing and store upkeep over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lexiquarry.operators import chunking as ck
from lexiquarry.operators import documents as o
from lexiquarry.operators import hooks as h
from lexiquarry.operators import intake as n
from lexiquarry.plans import rules
from lexiquarry.plans.chunking import _CHAIN, KINDS
from lexiquarry.plans.planted import planted, planted_sql, quoted
from lexiquarry.plans.registry import Registry
from lexiquarry.session import scratch_dir, table
from lexiquarry.sources import corpus_source
from lexiquarry.sources import readers as rd

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


def digest(c="text"):
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary")).alias("h")


def _files(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 9 == 0, F.unhex(F.lit("FF"))).otherwise(F.col("text").cast("binary")).alias("content"))


_FILES = "SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 9 <> 0 THEN text END AS text FROM documents"


@reg("sc2_pdf_pages", f"WITH f AS ({_FILES}), p AS (SELECT path, unnest(string_split(text, chr(10) || chr(10))) AS text, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS page FROM f WHERE text IS NOT NULL) SELECT path, page, md5(text) AS h, CASE WHEN trim(text) = '' THEN 'ocr' ELSE 'native' END AS route FROM p UNION ALL SELECT path, 1, md5(''), 'failed' FROM f WHERE text IS NULL")
def sc2(spark, d):
    pages = rd.extracted_pages(_files(spark, d), lambda raw: raw.decode("utf-8").split("\n\n"))
    route = F.when(F.col("error").isNotNull(), "failed").when(F.trim("text") == "", "ocr").otherwise("native")
    return pages.select("path", "page", digest(), route.alias("route"))


@reg("sc3_word_pages", f"WITH f AS ({_FILES}), p AS (SELECT path, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 30) AS p FROM f WHERE text IS NOT NULL) SELECT path, len(p) AS pages, md5(array_to_string(p, chr(1))) AS h FROM p WHERE len(p) > 0 UNION ALL SELECT path, 1, md5('') FROM f WHERE text IS NULL")
def sc3(spark, d):
    pages = rd.extracted_pages(_files(spark, d), lambda raw: [p for x in raw.decode("utf-8").split("\n") if len(p := x.strip(" ")) > 30])
    each = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("path").agg(F.count("*").alias("pages"), digest(F.array_join(F.transform(each, lambda x: x["text"]), "\u0001")))


@reg("sc5_image_pages", f"SELECT path, coalesce(length(text), 0) AS chars, text IS NULL AS failed FROM ({_FILES})")
def sc5(spark, d):
    pages = rd.extracted_pages(_files(spark, d), lambda raw: [raw.decode("utf-8")])
    return pages.select("path", F.length("text").alias("chars"), F.col("error").isNotNull().alias("failed"))


@reg("sc6_markdown_pages", "SELECT 1 AS page, '# ' || n_name || chr(10) || n_nationkey || chr(10) AS text FROM nation")
def sc6(spark, d):
    path = scratch_dir(spark)
    front = F.when(F.col("n_nationkey") % 2 == 0, F.lit("---\ntitle: x\n---\n")).otherwise("")
    table(spark, d, "nation").select(F.concat(front, F.lit("# "), "n_name", F.lit("\n"), F.col("n_nationkey").cast("string")).alias("text"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(path)
    return rd.markdown_pages(spark, path).select("page", "text")


@reg("sc8_json_exports", "SELECT r_name AS doc_id, 'region' AS doc_type, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS n, substr(n_name, 1, 5) AS text, CAST(n_nationkey AS INTEGER) AS page FROM nation JOIN region ON r_regionkey = n_regionkey")
def sc8(spark, d):
    path = scratch_dir(spark)
    n_ = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    chunk = F.struct(F.col("n_nationkey").cast("int").alias("page"), F.col("n_name").alias("text"))
    docs = n_.groupBy(F.col("r_name").alias("doc_id")).agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    docs.select("doc_id", F.col("doc_id").alias("k"), F.create_map(F.lit("doc_type"), F.lit("region")).alias("metadata"), "chunks").write.partitionBy("k").json(path)
    return rd.export_chunks(spark, path, most=5).select("doc_id", "doc_type", "n", "text", "page")


@reg("sc9_qa_lists", "SELECT text AS question, 'c' || item_id AS category FROM benchmark")
def sc9(spark, d):
    path = scratch_dir(spark)
    b = table(spark, d, "benchmark")
    good = b.select(F.to_json(F.struct(F.col("text").alias("question"), F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("category"), F.lit(1).alias("unknown"))).alias("value"))
    good.unionAll(b.select(F.concat(F.lit('{"question": '), F.col("item_id").cast("string")).alias("value"))).write.text(path)
    return rd.qa_list(spark, path).select("question", "category")


@reg("sc8_export_source", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_type, n - 1 AS n, text FROM (SELECT doc_id, source AS doc_type, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE lang = 'en' AND source = 'src1')")
def sc8_source(spark, d):
    """Exports by the data source; the folder and the type are filters that it takes over."""
    path = scratch_dir(spark)
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("text"), (i + 1).alias("page")))
    x = table(spark, d, "documents").select("lang", F.col("doc_id").cast("string").alias("doc_id"), F.create_map(F.lit("doc_type"), F.col("source")).alias("metadata"), lines.alias("chunks"))
    x.write.partitionBy("lang").json(path)
    corpus_source.register(spark)
    rows = spark.read.format("corpus_files").option("kind", "export").option("most", str(1 << 30)).load(path)
    return rows.filter((F.col("folder") == "lang=en") & (F.col("doc_type") == "src1")).select("doc_id", "doc_type", "n", "text")


@reg("sc9_qa_source", "SELECT text AS question, 'c' || item_id % 3 AS category FROM benchmark WHERE item_id % 3 = 1")
def sc9_source(spark, d):
    """Question lists with lines that are no JSON, by the data source."""
    path = scratch_dir(spark)
    b = table(spark, d, "benchmark")
    good = b.select(F.to_json(F.struct(F.col("text").alias("question"), F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"), F.lit(1).alias("unknown"))).alias("value"))
    good.unionAll(b.select(F.concat(F.lit('{"question": '), F.col("item_id").cast("string")).alias("value"))).write.text(path)
    corpus_source.register(spark)
    return spark.read.format("corpus_files").option("kind", "qa").load(path).filter("category = 'c1'").select("question", "category")


@reg("sk5_cascade_status", "WITH l AS (SELECT DISTINCT doc_id FROM labels), e AS (SELECT DISTINCT vec_id FROM embeddings), x AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS in_labels, e.vec_id IS NOT NULL AS in_vectors FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN e ON e.vec_id = d.doc_id) SELECT *, CASE WHEN in_labels AND in_vectors THEN 'full' WHEN in_labels OR in_vectors THEN 'partial' ELSE 'none' END AS outcome FROM x")
def sk5(spark, d):
    stores = {"in_labels": table(spark, d, "labels"), "in_vectors": table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")}
    return n.synced_status(table(spark, d, "documents").select("doc_id"), stores, "doc_id")


@reg("sk18_reset", "SELECT * FROM (VALUES ('labels', 0, 3), ('events', 0, 6)) AS t(name, n, columns_)")
def sk18(spark, d):
    out = []
    for name in ("labels", "events"):
        path, rows = scratch_dir(spark), table(spark, d, name)
        rows.write.parquet(path)
        n.cleared(rows, path)
        left = spark.read.parquet(path)
        out.append(left.agg(F.count("*").cast("int").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(len(left.columns)).alias("columns_")))
    return out[0].unionAll(out[1])


IDS = ["QCVN 06:2022/BXD SD1-2023 {}", "SD1-2026 x{}", "doc 06/2022/{}", "03/2021 {}", "QCVN 1:2019/{}", "free text {}", "VBPL/06/2022/{}"]


@reg("fn16_catalog_id", "SELECT doc_id, CASE CAST(doc_id % 7 AS INTEGER) WHEN 0 THEN 'VBPL/09/2023/TT-BXD' WHEN 1 THEN 'VBPL/31/2026/TT-BXD' WHEN 2 THEN 'VBPL/06/2022/TT-BXD' WHEN 3 THEN 'VBPL/03/2021/TT-BXD' WHEN 4 THEN 'VBPL/QCVN_01_2019/D' WHEN 5 THEN 'VBPL/free_text_D' || doc_id ELSE 'VBPL/06/2022/D' || doc_id END AS id FROM documents")
def fn16(spark, d):
    raw = F.element_at(F.array(*[F.replace(F.lit(x), F.lit("{}"), F.concat(F.lit("D"), F.col("doc_id").cast("string"))) for x in IDS]), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", n.catalog_id(raw).alias("id"))


_FEATURES = {"noise": "value", "skew": "(event_id % 30) / 10", "contrast": "event_id % 70", "density": "(event_id % 80) / 100"}


def _features(spark, d):
    return table(spark, d, "events").select("event_id", *[F.expr(e.replace("event_id %", "event_id %")).cast("double").alias(k) for k, e in _FEATURES.items()])


@reg("fn30_page_difficulty", f"WITH f AS (SELECT event_id, {', '.join(f'CAST({e} AS DOUBLE) AS {k}' for k, e in _FEATURES.items())} FROM events) SELECT event_id, least(100, CASE WHEN noise < 5 THEN 30 WHEN noise > 60 THEN 20 ELSE 0 END + CASE WHEN contrast < 30 THEN 25 WHEN contrast < 50 THEN 10 ELSE 0 END + CASE WHEN skew > 2.0 THEN 15 WHEN skew > 0.5 THEN 5 ELSE 0 END + CASE WHEN density < 0.05 THEN 15 WHEN density > 0.6 THEN 10 ELSE 0 END) AS score FROM f")
def fn30(spark, d):
    return _features(spark, d).select("event_id", n.page_difficulty(*map(F.col, _FEATURES)).alias("score"))


@reg("mx27_blank_pages", "SELECT doc_id, doc_id % 4 <> 0 AND length(trim(coalesce(text, ''))) <= 60 AND greatest(0, 1 - length(coalesce(text, '')) / 4000.0) > 0.9 AS blank FROM documents")
def mx27(spark, d):
    """A page of 4000 characters is full; what a text leaves of it is white."""
    white = F.greatest(F.lit(0.0), 1 - F.length(F.coalesce("text", F.lit(""))) / 4000.0)
    return table(spark, d, "documents").select("doc_id", n.is_blank_page(white, F.col("text"), F.col("doc_id") % 4 == 0).alias("blank"))


TOC = ["MỤC LỤC\n1.1 Phạm vi 5\n1.2. Đối tượng 7", "1. QUY ĐỊNH CHUNG 5 1.1 x", "1. Mot 2\n2. Hai 3\n3. Ba 4\n4. Bon 5", "plain page"]
_TOC = f"(length(text) >= 50 AND ((((contains(lower(text), 'mục lục') OR contains(lower(text), 'nội dung')) AND len(regexp_extract_all(text, {quoted(n.CONTENTS_LINE)})) >= 2)) OR len(regexp_extract_all(text, {quoted(n.CONTENTS_LINE)})) >= 4 OR regexp_matches(text, {quoted(n.CONTENTS_INLINE)})))"


@reg("mx28_contents_pages", f"SELECT doc_id, {_TOC} AS toc FROM {planted_sql(TOC)}")
def mx28(spark, d):
    return planted(spark, d, TOC).select("doc_id", n.is_contents(F.col("text")).alias("toc"))


_ROUTED = [*TOC, "Phụ lục 2 của bảng", "Tổng cộng: 5"]


@reg("mx29_page_routing", f"""WITH x AS (SELECT doc_id, text, doc_id * 7 % 100 AS score, doc_id % 3 = 0 AS has_table, doc_id * 11 % 80 AS diff, doc_id % 13 = 0 AS blank, doc_id % 17 = 0 AS failed, {_TOC} AS toc FROM {planted_sql(_ROUTED)}), y AS (SELECT *, NOT has_table AND regexp_matches(text, {quoted(n.ANNEX)}) AS annex, CASE WHEN has_table THEN 55 ELSE 70 END AS base FROM x)
 SELECT doc_id, CASE WHEN failed THEN 'vision' WHEN blank OR toc THEN 'empty' WHEN score < CASE WHEN annex THEN 80 WHEN diff >= 50 THEN least(90, base + 20) WHEN diff >= 25 THEN base + 10 ELSE base END OR annex THEN 'vision' ELSE 'ocr' END AS route FROM y""")
def mx29(spark, d):
    i = F.col("doc_id")
    route = n.page_route(i * 7 % 100, i % 3 == 0, i * 11 % 80, F.col("text"), i % 13 == 0, n.is_contents(F.col("text")), i % 17 == 0)
    return planted(spark, d, _ROUTED).select("doc_id", route.alias("route"))


_MARKS = "[àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđ]"


@reg("mx13_language_quality", f"WITH x AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM {planted_sql(['của các quy định', 'short'])}) SELECT doc_id, CASE WHEN length(text) < 10 THEN 0.0 ELSE round(least(100.0, least(30.0, length(text) / 50) + 40.0 * CAST(len(list_filter(w, lambda x: list_contains([{', '.join(map(quoted, n.COMMON_WORDS))}], lower(x)))) AS DOUBLE) / greatest(len(w), 1) + least(30.0, 300.0 * CAST(len(regexp_extract_all(text, '{_MARKS}')) AS DOUBLE) / greatest(length(text), 1))), 1) END AS score FROM x")
def mx13(spark, d):
    return planted(spark, d, ["của các quy định", "short"]).select("doc_id", n.language_quality(F.col("text")).alias("score"))


@reg("mx43_json_schema", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN doc_id END AS id, CASE WHEN doc_id % 3 < 2 THEN lang END AS lang FROM documents")
def mx43(spark, d):
    docs = table(spark, d, "documents")
    js = F.to_json(F.struct(F.col("doc_id").alias("id"), "lang", F.lit(1).alias("other")))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), js, F.lit("\n```\nbye"))).when(F.col("doc_id") % 3 == 1, js).otherwise(F.concat(F.lit("no "), js))
    return docs.select("doc_id", n.parsed_json(said, "id long, lang string").alias("x")).select("doc_id", "x.id", "x.lang")


EXPORTS = ["# Head\n## Content\nbody  with   spaces", "plain  body", "clean"]


@reg("mx22_export_reprocess", f"""WITH x AS (SELECT doc_id, text, strpos(text, '## Content' || chr(10)) AS m FROM {planted_sql(EXPORTS)}), y AS (SELECT doc_id, text, CASE WHEN m > 0 THEN substr(text, 1, m + 10) || regexp_replace(substr(text, m + 11), '  +', ' ', 'g') ELSE regexp_replace(text, '  +', ' ', 'g') END AS after_ FROM x)
 SELECT count(*) AS files, count(*) FILTER (text <> after_) AS changed, count(*) AS reverted, sum(CAST('0x' || substr(md5(after_), 1, 8) AS BIGINT)) AS checksum FROM y""")
def mx22(spark, d):
    docs = planted(spark, d, EXPORTS)
    v = n.reprocessed(docs, "doc_id", "text", F.regexp_replace(n.content_of(F.col("text")), "  +", " "))
    back = n.reverted(v, "doc_id", "text").join(docs, ["doc_id", "text"], "left_semi").agg(F.count("*").alias("reverted"))
    total = v.agg(F.count("*").alias("files"), F.count_if("changed").alias("changed"), F.sum(F.conv(F.substring(F.md5(F.col("after").cast("binary")), 1, 8), 16, 10).cast("long")).alias("checksum"))
    return total.crossJoin(back)


@reg("mx23_enrich_re_export", f"WITH c AS ({_CHAIN.replace('{source}', '(SELECT doc_id AS key, text FROM ' + planted_sql(KINDS) + ')')}) SELECT key AS doc_id, strategy, CAST(list_sum(list_transform(c, lambda x: length(x))) AS BIGINT) AS chars, coalesce(lang, 'unknown') AS authority FROM c JOIN documents ON doc_id = key WHERE len(c) > 0")
def mx23(spark, d):
    docs = planted(spark, d, KINDS)
    chunks = ck.chain_chunks(docs, "doc_id", "text").groupBy("doc_id", "strategy").agg(F.sum(F.length("chunk")).alias("chars"))
    return chunks.join(table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("authority")), "doc_id")


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')"


@reg("mx6_bundle_ingest", f"SELECT conv_id, turn - 1 - (min(turn) OVER (PARTITION BY conv_id) - 1) AS n, 'vbpl' AS namespace, len({_WORDS}) AS usage, round(sqrt(CASE WHEN length(text) > 0 THEN 1.0 ELSE 0.0 END), 3) AS norm FROM conversations")
def mx6(spark, d):
    c = table(spark, d, "conversations")
    bundles = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("chunks"))
    rows = n.bundle_rows(bundles, "conv_id", "chunks", {"namespace": "vbpl"}).select("conv_id", "n", "namespace", F.col("chunk.text").alias("text"))
    e = h.embedded(rows, h.hashed_vectors, "text")
    return e.select("conv_id", "n", "namespace", "usage", F.round(F.sqrt(F.aggregate("dense", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 3).alias("norm"))


@reg("mx45_embedding_batch", f"SELECT conv_id, turn, len({_WORDS}) AS usage, 16 AS width FROM conversations")
def mx45(spark, d):
    e = h.embedded(table(spark, d, "conversations").select("conv_id", "turn", "text"), h.hashed_vectors, "text")
    return e.select("conv_id", "turn", "usage", F.size("dense").alias("width"))


_LEXICAL = f"SELECT conv_id, turn, len({_WORDS}) AS usage, len(list_distinct({_WORDS})) AS terms, coalesce(list_max(list_transform(list_distinct({_WORDS}), lambda w: len(list_filter({_WORDS}, lambda x: x = w)))), 0) AS top FROM conversations"


@reg("vg2_hybrid_embed", _LEXICAL)
def vg2(spark, d):
    e = h.embedded(table(spark, d, "conversations").select("conv_id", "turn", "text"), h.hashed_vectors, "text", prefix="query: ")
    return e.select("conv_id", "turn", "usage", F.size("sparse").alias("terms"), F.coalesce(F.array_max(F.map_values("sparse")), F.lit(0)).alias("top"))


@reg("mx21_sparse_migration", _LEXICAL.replace("len(list_distinct", "16 AS width, len(list_distinct"))
def mx21(spark, d):
    old = table(spark, d, "conversations").select("conv_id", "turn", "text", F.lit(None).cast("map<string,int>").alias("sparse"))
    e = h.embedded(old.drop("sparse"), h.hashed_vectors, "text")
    return e.select("conv_id", "turn", "usage", F.size("dense").alias("width"), F.size("sparse").alias("terms"), F.coalesce(F.array_max(F.map_values("sparse")), F.lit(0)).alias("top"))


reg("mx7_bundle_topology", rules.ORACLES["sk8_topology_status"])(rules.QUERIES["sk8_topology_status"])
reg("vg6_timeline_twin", rules.ORACLES["vg5_legal_timeline"])(rules.QUERIES["vg5_legal_timeline"])


@reg("wn6_hop2_expansion", """WITH f AS (SELECT user_id, event_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS text, value FROM events WHERE event_type = 'view'), s AS (SELECT user_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS text, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2), p AS (SELECT user_id FROM f GROUP BY 1 HAVING NOT (count(*) >= 4 OR avg(value) >= 70))
 SELECT user_id, text, 1 AS hop, count(*) AS n FROM f GROUP BY 1, 2 UNION ALL SELECT user_id, text, 2, 1 FROM s WHERE user_id IN (SELECT user_id FROM p) AND NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = s.user_id AND f.text = s.text)""")
def wn6(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.floor("value").cast("string").alias("text"), "value")
    hop = lambda kind: e.filter(F.col("event_type") == kind).drop("event_type")
    out = h.hop2(hop("view"), hop("click"), "user_id", "text", (F.count("*") >= 4) | (F.avg("value") >= 70))
    return out.groupBy("user_id", "text", "hop").agg(F.count("*").alias("n"))


@reg("cv5_batch_verify")
def cv5(spark, d):
    c = table(spark, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("premise")).join(b, ["conv_id", "turn"])
    return o.heuristic_entailment(pairs).select("conv_id", "turn", "status", F.round(F.col("probs")[0], 6).alias("entails"))


@reg("cv7_model_judge", "WITH p AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) SELECT conv_id, turn, CAST(CASE WHEN turn % 5 = 3 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS faithfulness, CAST(CASE WHEN turn % 5 = 3 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS relevance, CASE WHEN turn % 5 = 3 THEN 50.0 ELSE CAST(length(q) % 100 AS DOUBLE) END AS score FROM p WHERE a IS NOT NULL")
def cv7(spark, d):
    def judge(question: str, answer: str):
        turn, _, text = question.partition("|")
        if int(turn) % 5 == 3:
            raise RuntimeError("no model")
        return 1.0, 0.25, len(text) % 100

    c = table(spark, d, "conversations")
    pairs = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a")), ["conv_id", "turn"])
    pairs = pairs.select("conv_id", "turn", F.concat_ws("|", F.col("turn").cast("string"), "text").alias("q"), "a")
    return h.judged(pairs, judge, "q", "a").select("conv_id", "turn", "faithfulness", "relevance", "score")


@reg("ud1_scorer_hook", "SELECT conv_id, turn, CAST(CASE WHEN length(text) % 2 = 0 THEN 0.75 END AS DOUBLE) AS entails FROM conversations")
def ud1(spark, d):
    def scorer(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        even = a.str.len() % 2 == 0
        return pd.DataFrame({"e": even.map({True: 0.75, False: 2.0}), "n": 0.125, "c": 0.125})

    return h.scored(table(spark, d, "conversations"), scorer, "text", "role").select("conv_id", "turn", F.col("probs")[0].alias("entails"))


@reg("ud2_reranker_hook", "SELECT doc_id, CAST(least(length(text), 1500) AS DOUBLE) AS rerank FROM documents")
def ud2(spark, d):
    return h.reranked(table(spark, d, "documents"), lambda q, t: t.str.len(), "lang", "text").select("doc_id", "rerank")


@reg("ud3_sampler_hook", "SELECT doc_id, lang FROM documents")
def ud3(spark, d):
    def sampler(batch: pd.DataFrame) -> None:
        batch.drop(batch.index, inplace=True)
        raise RuntimeError("swallowed")

    return h.sampled(table(spark, d, "documents").select("doc_id", "lang"), sampler)


@reg("ud4_query_rewrite", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN upper(role) ELSE role END AS rewritten FROM conversations")
def ud4(spark, d):
    def rewrite(x: str):
        k, _, role = x.partition(":")
        if k == "2":
            raise RuntimeError("no model")
        return f"1:{role.upper()}" if k == "1" else None

    c = table(spark, d, "conversations").withColumn("q", F.concat_ws(":", (F.col("turn") % 3).cast("string"), "role"))
    return h.rewritten(c, rewrite, "q").select("conv_id", "turn", F.regexp_replace("rewritten", "^[0-9]:", "").alias("rewritten"))


@reg("ud5_planner_hook", "WITH x AS (SELECT doc_id, lang, string_split(text, '. ')[1:3] AS s, text FROM documents), y AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN [text] ELSE s END AS s FROM x), u AS (SELECT doc_id, unnest(s) AS q, generate_subscripts(s, 1) - 1 AS n FROM y) SELECT doc_id, n, md5(q) AS h FROM u")
def ud5(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("\u0002"), "text")).otherwise(F.col("text")).alias("text"))

    def plan(x: str) -> list[str]:
        if x.startswith("\u0002"):
            raise RuntimeError("no model")
        return x.split(". ")

    return h.planned(docs, plan, "text").select("doc_id", "n", digest(F.regexp_replace("sub_query", "^\u0002", "")))


@reg("ud6_custom_strategy", "WITH u AS (SELECT doc_id, unnest(string_split(text, '. ')) AS c, generate_subscripts(string_split(text, '. '), 1) - 1 AS n FROM documents) SELECT doc_id, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS chars FROM u GROUP BY 1")
def ud6(spark, d):
    c = h.custom_chunks(table(spark, d, "documents"), lambda s: s.split(". "), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("chars"))
