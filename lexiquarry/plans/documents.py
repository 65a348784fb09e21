"""Classification, text passes, chunking, audits and state bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.functions import text as t
from lexiquarry.operators import documents as o
from lexiquarry.operators import phrases
from lexiquarry.operators.intervals import interval_join
from lexiquarry.plans.planted import quoted
from lexiquarry.plans.registry import Registry
from lexiquarry.session import scratch_dir, table
from lexiquarry.sources.keyed_store import KeyedStore
from lexiquarry.sources.writers import write_observed

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


#: DuckDB's spelling of functions.text.fold over the column text.
FOLDED = "translate(lower(text), '" + "".join(t.ACCENTED.values()) + "', '" + "".join(k * len(v) for k, v in t.ACCENTED.items()) + "')"


@reg("cl4_source_category", "SELECT page_id, CASE WHEN url LIKE '%example.org%' THEN 'QUOC_HOI' WHEN url LIKE '%/en/%' THEN 'CHINH_PHU' WHEN url LIKE '%.html%' THEN 'QUY_CHUAN' ELSE 'KHAC' END AS category FROM pages")
def cl4(spark, d):
    u = F.col("url")
    rules = [(F.contains(u, F.lit("example.org")), F.lit("QUOC_HOI")), (F.contains(u, F.lit("/en/")), F.lit("CHINH_PHU")), (F.contains(u, F.lit(".html")), F.lit("QUY_CHUAN"))]
    return table(spark, d, "pages").select("page_id", o.first_match(rules, F.lit("KHAC")).alias("category"))


@reg("cv6_faithfulness", "WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: trim(x)), lambda x: x <> '') AS sents, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 4)) AS w FROM documents), p AS (SELECT a.doc_id, a.sents, b.w FROM s a JOIN s b ON b.doc_id = a.doc_id + 2), c AS (SELECT doc_id, sents, list_transform(sents, lambda x: list_distinct(list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda v: length(v) >= 4))) AS ts, w FROM p) SELECT doc_id, round(len(list_filter(ts, lambda t: len(t) = 0 OR len(list_intersect(t, w)) >= 0.4 * len(t))) / greatest(len(sents), 1), 6) AS faithful FROM c")
def cv6(spark, d):
    docs = table(spark, d, "documents")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 4))
    a = docs.select("doc_id", F.filter(F.transform(F.split("text", "[.!?]"), lambda x: F.trim(x)), lambda x: x != "").alias("sents"))
    b = docs.select((F.col("doc_id") - 2).alias("doc_id"), words(F.col("text")).alias("w"))
    ok = F.filter("sents", lambda x: (F.size(words(x)) == 0) | (F.size(F.array_intersect(words(x), F.col("w"))) >= 0.4 * F.size(words(x))))
    return a.join(b, "doc_id").select("doc_id", F.round(F.size(ok) / F.greatest(F.size("sents"), F.lit(1)), 6).alias("faithful"))


@reg("fn1_squash", "SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x{A0}]+', ' ', 'g'))) AS h FROM documents")
def fn1(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(t.squash(F.col("text")).cast("binary")).alias("h"))


@reg("fn8_content_tokens", "SELECT doc_id, len(list_filter(list_distinct(list_filter(string_split(regexp_replace(" + FOLDED + ", '[^a-z0-9%]+', ' ', 'g'), ' '), lambda w: length(w) > 1)), lambda w: NOT list_contains([" + ",".join(quoted(w) for w in t.STOPWORDS) + "], w))) AS n FROM documents")
def fn8(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(t.content_tokens(F.col("text"))).cast("long").alias("n"))


@reg("fn11_cache_key", "SELECT doc_id, length('t0:' || sha256(text)) AS n FROM documents")
def fn11(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(t.cache_key(F.col("text"), F.col("lang"), F.lit(10))).cast("long").alias("n"))


@reg("fn12_content_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def fn12(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))


@reg("fn13_provenance", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'NON_STATUTORY' WHEN 1 THEN 'NO_SOURCE' WHEN 2 THEN 'VERIFIED' ELSE 'TAMPERED' END AS status FROM documents")
def fn13(spark, d):
    h = F.sha2(F.col("text").cast("binary"), 256)
    x = table(spark, d, "documents").withColumns({"statutory": F.col("doc_id") % 4 != 0, "expected": F.when(F.col("doc_id") % 4 == 2, F.upper(h)).when(F.col("doc_id") % 4 == 3, "00")})
    return x.select("doc_id", F.when(~F.col("statutory"), "NON_STATUTORY").when(F.col("expected").isNull(), "NO_SOURCE").when(F.lower(h) == F.lower("expected"), "VERIFIED").otherwise("TAMPERED").alias("status"))


@reg("fn27_token_estimate", "SELECT conv_id, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def fn27(spark, d):
    parts = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("parts"))
    total = F.aggregate(F.transform("parts", lambda x: F.length(x)), F.lit(0), lambda a, x: a + x)
    return parts.select("conv_id", F.floor(total / 4).alias("tokens"))


@reg("fn28_tier_routing", "SELECT conv_id, CASE WHEN sum(length(text)) // 4 < 500 THEN 'small' ELSE 'large' END AS tier FROM conversations GROUP BY 1")
def fn28(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.when(F.floor(F.sum(F.length("text")) / 4) < 500, "small").otherwise("large").alias("tier"))


@reg("fn35_pagination", "SELECT doc_id, substr(text, 101, 100) AS page FROM documents")
def fn35(spark, d):
    return table(spark, d, "documents").select("doc_id", t.page_of(F.col("text"), 2, 100).alias("page"))


@reg("tx11_dot_leaders", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?:\\.\\s*){20,}', '', 'g'), '(?:\\.\\s){10,}', '', 'g')) AS h FROM documents")
def tx11(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(t.strip_dots(F.col("text")).cast("binary")).alias("h"))


_PARAS = "CASE WHEN length(text) < 200 THEN text ELSE array_to_string(list_transform(list_filter(list_transform(list_zip(p, range(1, len(p) + 1)), lambda z: CASE WHEN list_position(p, z[1]) = z[2] THEN z[1] END), lambda z: z IS NOT NULL), lambda z: z), chr(10) || chr(10)) END"


@reg("mx8_paragraph_dedup", f"WITH x AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), y AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda s: trim(s)), lambda s: s <> '') AS p FROM x) SELECT doc_id, md5({_PARAS}) AS h FROM y")
def mx8(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return x.select("doc_id", F.md5(t.dedup_paragraphs(F.col("text")).cast("binary")).alias("h"))


@reg("mx14_phrase_coverage", """WITH b AS (SELECT item_id, lower(string_split(text, chr(10))[1]) AS phrase, item_id % 4 = 0 AS is_banned FROM benchmark), w AS (SELECT list_sort(list(item_id) FILTER (NOT is_banned)) AS wanted FROM b),
 h AS (SELECT doc_id, coalesce(list_sort(list(item_id) FILTER (NOT is_banned AND contains(lower(text), phrase))), []) AS hits, coalesce(list_sort(list(item_id) FILTER (is_banned AND contains(lower(text), phrase))), []) AS banned FROM documents, b GROUP BY 1)
 SELECT doc_id, hits, list_filter(wanted, lambda x: NOT list_contains(hits, x)) AS misses, banned, round(greatest(100.0 * len(hits) / len(wanted) - 10.0 * len(banned), 0.0), 1) AS score FROM h, w""")
def mx14(spark, d):
    p = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.split("text", "\n")[0].alias("phrase"), (F.col("item_id") % 4 == 0).alias("is_banned"))
    return phrases.phrase_scores(table(spark, d, "documents"), "doc_id", "text", p)


@reg("pf4_keep_all_if_noise", "WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT *, length(trim(line)) < 40 AS noise, bool_or(length(trim(line)) >= 40) OVER (PARTITION BY doc_id) AS good FROM c) SELECT doc_id, count(*) AS n FROM n WHERE NOT noise OR NOT good GROUP BY 1")
def pf4_docs(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return o.without_noise(c, "doc_id", "line").groupBy("doc_id").agg(F.count("*").alias("n"))


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@reg("pf5_garbled_table", f"""WITH x AS (SELECT doc_id, text, {_LINES} AS l FROM documents), y AS (SELECT *, len(list_filter(l, lambda s: length(s) < 25)) / greatest(len(l), 1) AS sr, len(list_filter(l, lambda s: list_contains(['X','Χ','Х','x','.','-','_','*'], s))) / greatest(len(l), 1) AS mr, trim(substr(text, 1, 200)) AS sample FROM x)
 SELECT doc_id, length(text) >= 50 AND len(l) >= 3 AND ((sr > 0.5 AND mr > 0.1) OR (sr > 0.7 AND mr > 0.05) OR (length(text) > 500 AND sample <> '' AND (length(text) - length(replace(text, sample, ''))) / greatest(length(sample), 1) >= 3)) AS garbled FROM y""")
def pf5(spark, d):
    return o.with_garbled_table(table(spark, d, "documents").select("doc_id", "text"), "text", "garbled").select("doc_id", "garbled")


@reg("pf9_broken_table", f"WITH x AS (SELECT doc_id, text, list_transform({_LINES}, lambda s: length(s) - length(replace(s, '|', ''))) AS c FROM documents) SELECT doc_id, coalesce((length(text) - length(replace(text, '|', '')) > 2 AND list_max(c) <> list_min(c) AND list_min(c) = 0), false) OR regexp_matches(text, '\\.{{5,}}| {{5,}}') AS broken FROM x")
def pf9(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(o.is_broken_table(F.col("text")), F.lit(False)).alias("broken"))


@reg("pf14_short_pages", "WITH l AS (SELECT conv_id, turn, length(text) AS n FROM conversations), m AS (SELECT conv_id, list_sort(list(n))[len(list(n)) // 2 + 1] AS median, count(*) AS k FROM l GROUP BY 1) SELECT l.conv_id, l.turn FROM l JOIN m ON l.conv_id = m.conv_id WHERE k >= 3 AND median >= 100 AND n < 0.75 * median")
def pf14(spark, d):
    return o.short_pages(table(spark, d, "conversations"), "conv_id", "turn", "text", 0.75)


@reg("pf16_completed_lookup", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def pf16(spark, d):
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    return table(spark, d, "documents").join(done, "doc_id", "left_semi").select("doc_id")


# Ends of sentences without look-around: dots behind digits are set aside first, and starts of
# lines that need what follows them are looked for twice, as two of them may share a line feed.
_ENDS = "regexp_replace(regexp_replace(text, '([0-9])\\.', '\\1' || chr(2), 'g'), '\\.\\s+', chr(1), 'g')"
for _mark in ("'\\n([0-9]+[.)' || chr(2) || '][\\s' || chr(1) || '])'",) * 2 + ("'\\n([a-z]\\)[\\s' || chr(1) || '])'",) * 2 + ("'\\n([A-Z])'",):
    _ENDS = f"regexp_replace({_ENDS}, {_mark}, chr(1) || '\\1', 'g')"
_SENTENCES = f"list_filter(list_transform(string_split(replace({_ENDS}, chr(2), '.'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_JOINED = "CASE WHEN a.buf = '' THEN x.buf ELSE a.buf || ' ' || x.buf END"
_FOLD = f"list_reduce([{{'done': CAST([] AS VARCHAR[]), 'buf': ''}}] || list_transform({_SENTENCES}, lambda x: {{'done': CAST([] AS VARCHAR[]), 'buf': x}}), lambda a, x: {{'done': CASE WHEN length({_JOINED}) >= 300 THEN list_append(a.done, {_JOINED}) ELSE a.done END, 'buf': CASE WHEN length({_JOINED}) >= 300 THEN '' ELSE {_JOINED} END}})"
_PACKS = "CASE WHEN m.buf = '' THEN m.done WHEN len(m.done) > 0 AND length(m.buf) < 150 THEN list_append(m.done[1:len(m.done) - 1], m.done[len(m.done)] || ' ' || m.buf) WHEN length(m.buf) > 100 THEN list_append(m.done, m.buf) ELSE m.done END"
_PACKED = f"packed AS (SELECT doc_id, text, {_PACKS} AS packs FROM (SELECT doc_id, text, {_FOLD} AS m FROM documents))"


@reg("wn18_sentence_packing", f"WITH {_PACKED} SELECT doc_id, i - 1 AS n, length(packs[i]) AS len, md5(packs[i]) AS h FROM (SELECT doc_id, packs, unnest(range(1, len(packs) + 1)) AS i FROM packed)")
def wn18(spark, d):
    k = table(spark, d, "documents").select("doc_id", F.posexplode(o.packed_sentences(F.col("text"))).alias("n", "chunk"))
    return k.select("doc_id", "n", F.length("chunk").alias("len"), F.md5(F.col("chunk").cast("binary")).alias("h"))


@reg("ch7_fallback_chunks", f"WITH {_PACKED} SELECT doc_id, 'parent' AS chunk_type, 0 AS n, length(text) AS len FROM documents WHERE length(text) > 30 UNION ALL SELECT doc_id, 'child', i, length(packs[i]) FROM (SELECT doc_id, packs, unnest(range(1, len(packs) + 1)) AS i FROM packed WHERE length(text) > 300)")
def ch7(spark, d):
    return o.fallback_chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_type", "n", F.length("chunk").alias("len"))


@reg("ch3_marked_sections", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\n'), lambda x: starts_with(x, 'The'))) + CASE WHEN NOT starts_with(text, 'The') AND trim(regexp_split_to_array(text, '\\nThe')[1]) <> '' THEN 1 ELSE 0 END AS n FROM documents")
def ch3(spark, d):
    s = o.marked_sections(table(spark, d, "documents"), "doc_id", "text", "^The")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"))


@reg("ag10_text_audit")
def ag10(spark, d):
    return o.text_audit(table(spark, d, "documents"), "text")


@reg("ag12_chunk_audit")
def ag12(spark, d):
    return o.chunk_audit(o.fallback_chunks(table(spark, d, "documents"), "doc_id", "text"))


@reg("ag11_missing_fields", "SELECT count(*) FILTER (quality IS NULL) AS no_label, count(*) FILTER (quality IS NOT NULL AND toxic = 1) AS toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id)")
def ag11(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return x.agg(F.count_if(F.col("quality").isNull()).alias("no_label"), F.count_if(F.col("quality").isNotNull() & (F.col("toxic") == 1)).alias("toxic"), F.count("*").alias("n"))


@reg("ag13_index_census", "SELECT count(*) AS total, count(DISTINCT label) AS labels, count(*) FILTER (label = 0) AS zero FROM embeddings")
def ag13(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("total"), F.countDistinct("label").alias("labels"), F.count_if(F.col("label") == 0).alias("zero"))


@reg("ag14_fidelity", "WITH c AS (SELECT conv_id, count(*) AS pages, sum(length(text)) AS chars FROM conversations GROUP BY 1) SELECT count(*) AS docs, round(avg(pages), 6) AS mean_pages, CAST(max(chars) AS BIGINT) AS max_chars FROM c")
def ag14(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))
    return c.agg(F.count("*").alias("docs"), F.round(F.avg("pages"), 6).alias("mean_pages"), F.max("chars").alias("max_chars"))


@reg("ag16_dataset_summary", "SELECT lang, count(*) FILTER (doc_id % 2 = 0) AS even, count(*) FILTER (doc_id % 2 = 1) AS odd FROM documents GROUP BY 1")
def ag16(spark, d):
    x = table(spark, d, "documents").withColumn("half", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    return x.groupBy("lang").pivot("half", ["even", "odd"]).agg(F.count(F.lit(1))).na.fill(0)


_LANGS = ("de", "en", "es", "fr")
_LANG = f"CASE WHEN lang IN ({', '.join(map(quoted, _LANGS))}) THEN lang ELSE 'other' END"


@reg("ag16_observed_summary", f"WITH l AS (SELECT unnest([{', '.join(map(quoted, (*_LANGS, 'other')))}]) AS lang), x AS (SELECT {_LANG} AS lang, doc_id % 2 = 0 AS is_even FROM documents) SELECT l.lang, count(is_even) FILTER (is_even) AS even, count(is_even) FILTER (NOT is_even) AS odd FROM l LEFT JOIN x USING (lang) GROUP BY 1")
def ag16_observed(spark, d):
    """Counts by type and category of an export, taken in the pass that writes it."""
    x = table(spark, d, "documents").select("doc_id", F.expr(_LANG).alias("lang"), "text")
    even = F.col("doc_id") % 2 == 0
    metrics = {f"{n}_{half}": F.count_if((F.col("lang") == n) & (even if half == "even" else ~even)) for n in (*_LANGS, "other") for half in ("even", "odd")}
    got = write_observed(x, lambda rows: rows.write.partitionBy("lang").parquet(f"{scratch_dir(spark)}/export"), **metrics)
    return spark.createDataFrame([(n, got[f"{n}_even"], got[f"{n}_odd"]) for n in (*_LANGS, "other")], "lang string, even long, odd long")


@reg("ag19_citation_sets", "SELECT l_returnflag, round(avg(l_discount), 6) AS mean, count(*) FILTER (l_discount < 0.02) AS failed FROM lineitem GROUP BY 1")
def ag19(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_discount"), 6).alias("mean"), F.count_if(F.col("l_discount") < 0.02).alias("failed"))


_STATE = "s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'CLAIMED' ELSE 'COMPLETED' END AS status, o_custkey % 5 AS retries, o_orderdate < TIMESTAMP '1998-01-01' AS stale FROM orders)"


@reg("sk10_claim_upsert", f"""WITH {_STATE}, c AS (SELECT *, o_orderkey % 3 = 0 AND (status = 'PENDING' OR (status = 'FAILED' AND retries < 3) OR (status = 'CLAIMED' AND stale)) AS mine FROM s)
 SELECT o_orderkey, CASE WHEN mine THEN 'CLAIMED' ELSE status END AS status, CASE WHEN mine THEN 'w1' WHEN status = 'CLAIMED' THEN 'w0' END AS owner FROM c UNION ALL SELECT o_orderkey + 1000000000, 'CLAIMED', 'w1' FROM orders WHERE o_orderkey % 300 = 0""")
def sk10(spark, d):
    """Worker w1 claims a third of the files and some new ones, w2 the same a moment later, in vain."""
    x = table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    s = x.select("o_orderkey", F.when(k == 0, "PENDING").when(k == 1, "FAILED").when(k == 2, "CLAIMED").otherwise("COMPLETED").alias("status"), (F.col("o_custkey") % 5).cast("int").alias("retries"))
    s = s.withColumns({"owner": F.when(F.col("status") == "CLAIMED", "w0"), "claimed_at": F.lit(1000.0)})
    old = x.filter("o_orderdate < '1998-01-01'").select("o_orderkey", F.lit(0.0).alias("old"))
    s = s.join(old, "o_orderkey", "left").withColumn("claimed_at", F.coalesce("old", "claimed_at")).drop("old")
    store = KeyedStore(spark, scratch_dir(spark), "o_orderkey", "o_orderkey long, status string, retries int, owner string, claimed_at double")
    store.create(s)
    files = x.filter("o_orderkey % 3 = 0").select("o_orderkey").unionByName(x.filter("o_orderkey % 300 = 0").select((F.col("o_orderkey") + 1_000_000_000).alias("o_orderkey")))
    for worker, now in (("w1", 1060.0), ("w2", 1061.0)):
        o.claim(store, files.withColumns({"owner": F.lit(worker), "claimed_at": F.lit(now)}))
    return store.read().select("o_orderkey", "status", "owner")


@reg("sk11_collision_suffix", "SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) > 1 THEN c_mktsegment || '_DUP_' || substr(md5(c_name), 1, 6) ELSE c_mktsegment END AS unique_id FROM customer")
def sk11(spark, d):
    return o.collision_free_ids(table(spark, d, "customer"), "c_mktsegment", "c_name").select("c_custkey", "unique_id")


@reg("sk12_json_field_set", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'ACTIVE' AS validity FROM events")
def sk12(spark, d):
    m = F.from_json("props", "map<string,string>")
    new = F.map_concat(F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: k != "validity"), F.create_map(F.lit("validity"), F.lit("ACTIVE")))
    return table(spark, d, "events").withColumn("m", new).select("event_id", F.col("m")["k"].cast("long").alias("k"), F.col("m")["validity"].alias("validity"))


@reg("jn5_checkpoint_join", "SELECT count(*) AS n, count(*) >= 850 + 50 AS due, (count(*) // 50) * 50 AS checkpoint FROM documents")
def jn5(spark, d):
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    return o.checkpoint_due(n, spark.createDataFrame([(850,)], "last long"))


@reg("sk3_delete_by_id", "SELECT doc_id FROM documents WHERE NOT (doc_id = 7 OR source = 'src3')")
def sk3(spark, d):
    return table(spark, d, "documents").filter(~((F.col("doc_id") == 7) | (F.col("source") == "src3"))).select("doc_id")


@reg("sk2_status_upsert", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'OUTDATED' ELSE 'ACTIVE' END AS status, source, 0 AS written_again FROM documents UNION ALL SELECT doc_id + 1000000000, 'OUTDATED', NULL, 0 FROM documents WHERE doc_id % 100 = 0")
def sk2(spark, d):
    """One source's documents and some new ones become outdated; the same upsert again writes nothing."""
    x = table(spark, d, "documents").select("doc_id", F.lit("ACTIVE").alias("status"), "source")
    store = KeyedStore(spark, scratch_dir(spark), "doc_id", "doc_id long, status string, source string")
    store.create(x)
    ids = x.filter("source = 'src1'").select("doc_id").unionByName(x.filter("doc_id % 100 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id")))
    new = ids.withColumn("status", F.lit("OUTDATED"))
    again = [store.upsert(new, {"status": F.col("new.status")}) for _ in range(2)][1]
    return store.read().withColumn("written_again", F.lit(len(again)))


@reg("mx17_children_per_parent", "SELECT r_name, count(n_nationkey) AS children FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def mx17(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return table(spark, d, "region").join(n, "r_regionkey", "left").groupBy("r_name").agg(F.count("n_nationkey").alias("children"))


@reg("mx38_recent_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6")
def mx38(spark, d):
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").withColumn("k", k).filter("k <= 6").select("conv_id", "turn", "role")


@reg("mx37_context_format", "SELECT conv_id, string_agg('[' || turn || '] ' || text, chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1")
def mx37(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "text").alias("s"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["s"]), "\n").alias("context"))


@reg("mx39_review_filter", "SELECT event_id FROM events WHERE value BETWEEN 1 AND 5 ORDER BY ts DESC, event_id DESC LIMIT 1000")
def mx39(spark, d):
    return table(spark, d, "events").filter(F.col("value").between(1, 5)).orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id")


@reg("mx31_broken_spacing", "WITH x AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents) SELECT doc_id, len(w) > 5 AND len(list_filter(w, lambda s: length(s) <= 2 AND regexp_full_match(s, '[A-Za-z]+'))) > 0.3 * len(w) AS broken FROM x")
def mx31(spark, d):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    short = F.size(F.filter("w", lambda x: (F.length(x) <= 2) & x.rlike("^[A-Za-z]+$")))
    return table(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", ((F.size("w") > 5) & (short > 0.3 * F.size("w"))).alias("broken"))


@reg("jn13_line_in_segment", """WITH l AS (SELECT l_orderkey AS page, l_linenumber AS n, l_partkey % 100 AS x, 15 * l_linenumber + l_quantity % 10 AS y FROM lineitem),
 s AS (SELECT *, top + 28 AS bottom, edge + 80 AS side FROM (SELECT o_orderkey AS page, k, 30 * k + o_custkey % 13 AS top, o_orderkey % 7 AS edge FROM orders, (SELECT unnest(range(0, 4)) AS k)))
 SELECT s.page, k, count(*) AS n, string_agg(n, ' ' ORDER BY y, n) AS lines FROM l JOIN s ON l.page = s.page AND y >= top AND y < bottom AND x >= edge AND x < side GROUP BY 1, 2""")
def jn13(spark, d):
    """Lines whose centre lies in a segment's box, from top to bottom."""
    i, k = table(spark, d, "lineitem"), F.col("k")
    lines = i.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 100).alias("x"), (15 * F.col("l_linenumber") + F.col("l_quantity") % 10).alias("y"))
    s = table(spark, d, "orders").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    s = s.select(F.col("o_orderkey").alias("page"), k.cast("long").alias("k"), (30 * k + F.col("o_custkey") % 13).alias("top"), (F.col("o_orderkey") % 7).alias("edge"))
    s = s.withColumns({"bottom": F.col("top") + 28, "side": F.col("edge") + 80})
    met = interval_join(lines, "y", s, "top", "bottom", ("page",)).filter("x >= edge AND x < side")
    held = F.array_sort(F.collect_list(F.struct("y", "n")))
    return met.groupBy("page", "k").agg(F.count("*").alias("n"), F.array_join(F.transform(held, lambda v: v["n"].cast("string")), " ").alias("lines"))


@reg("jn6_alias_resolution", "SELECT c_custkey, c_custkey % 100 AS target FROM customer")
def jn6(spark, d):
    """Exact, lower-cased, swapped and bare forms of an alias, in this order."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper(F.concat(F.lit("doc-"), (F.col("c_custkey") % 100).cast("string")))).otherwise(F.concat(F.lit("doc_"), (F.col("c_custkey") % 100).cast("string"))).alias("alias"))
    names = F.broadcast(spark.range(100).select(F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("name"), F.col("id").alias("target")))
    for k, form in enumerate((F.col("alias"), F.lower("alias"), F.replace(F.col("alias"), F.lit("_"), F.lit("-")))):
        c = c.withColumn("_f", form).join(names.select(F.col("name").alias("_f"), F.col("target").alias(f"t{k}")), "_f", "left").drop("_f")
    return c.select("c_custkey", F.coalesce("t0", "t1", "t2").alias("target"))


@reg("jn7_alias_map", "SELECT alias, max(s_suppkey) AS id FROM (SELECT s_suppkey, unnest([s_name, lower(s_name), 'n' || s_nationkey]) AS alias FROM supplier) GROUP BY 1")
def jn7(spark, d):
    forms = F.explode(F.array("s_name", F.lower("s_name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))))
    return table(spark, d, "supplier").select("s_suppkey", forms.alias("alias")).groupBy("alias").agg(F.max("s_suppkey").alias("id"))


@reg("jn4_timeline_enrichment", "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1), h AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, dense_rank() OVER (ORDER BY o_custkey) AS r FROM orders WHERE o_custkey IN (SELECT o_custkey FROM t)) SELECT o_orderkey, k = 1 AND r <= 2 AS enriched FROM h")
def jn4(spark, d):
    from pyspark.sql import Window as W

    x = table(spark, d, "orders")
    t2 = x.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 1")
    h = x.join(t2, "o_custkey", "left_semi")
    first = h.select("o_custkey").distinct().orderBy("o_custkey").limit(2).withColumn("hit", F.lit(True))
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return h.withColumn("k", k).join(F.broadcast(first), "o_custkey", "left").select("o_orderkey", ((F.col("k") == 1) & F.coalesce("hit", F.lit(False))).alias("enriched"))


@reg("wn15_duplicate_resolution", "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_suppkey % 20 AS n, lag(l_suppkey % 20) OVER w AS p, lead(l_suppkey % 20) OVER w AS f FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)), s AS (SELECT *, CASE WHEN p = n - 1 THEN 2 WHEN p < n THEN 1 ELSE 0 END + CASE WHEN f = n + 1 THEN 3 WHEN f > n THEN 1 ELSE 0 END AS score FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, n ORDER BY score DESC, l_linenumber DESC, l_partkey, l_extendedprice) AS k FROM s) SELECT l_orderkey, l_linenumber, k = 1 AS kept FROM r")
def wn15(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_suppkey") % 20).alias("n"))
    p, f, n = F.lag("n").over(w), F.lead("n").over(w), F.col("n")
    s = x.withColumn("score", F.when(p == n - 1, 2).when(p < n, 1).otherwise(0) + F.when(f == n + 1, 3).when(f > n, 1).otherwise(0))
    k = F.row_number().over(W.partitionBy("l_orderkey", "n").orderBy(F.desc("score"), F.desc("l_linenumber"), "l_partkey", "l_extendedprice"))
    return s.select("l_orderkey", "l_linenumber", (k == 1).alias("kept"))
