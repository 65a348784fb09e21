"""Classification, predicates, chunking and audits of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.sources.keyed_store import KeyedStore

# Ordered rules of the classifiers.
DOC_TYPES = (
    (("QCVN",), "QCVN"), (("TCVN",), "TCVN"), (("VBHN",), "VB_HOP_NHAT"), (("NĐ-", "NĐ/", "ND-", "ND/"), "NGHI_DINH"), (("NQ-", "NQ/", "QH15", "QH14"), "NGHI_QUYET"),
    (("QĐ-", "QĐ/", "QD-", "QD/"), "QUYET_DINH"), (("TTR-", "TTR/"), "TO_TRINH"), (("TT-", "TT/"), "THONG_TU"), (("CT-", "CT/"), "CHI_THI"), (("TB-", "TB/"), "THONG_BAO"), (("CV-", "CV/"), "CONG_VAN"),
)
NAME_TYPES = (("QCVN", "QCVN"), ("TCVN", "TCVN"), ("VBHN", "VB_HOP_NHAT"), (r"N[ĐD]\d", "NGHI_DINH"), (r"NQ\d", "NGHI_QUYET"), (r"Q[ĐD]\d", "QUYET_DINH"), (r"TTr\d", "TO_TRINH"), (r"TT\d", "THONG_TU"), (r"CT\d", "CHI_THI"), (r"TB\d", "THONG_BAO"), (r"CV\d", "CONG_VAN"))
LEVELS = {"HIEN_PHAP": "HIEN_PHAP", "BO_LUAT": "LUAT", "LUAT": "LUAT", "PHAP_LENH": "LUAT", "NGHI_DINH": "NGHI_DINH", "NGHI_QUYET": "NGHI_QUYET", "QUYET_DINH": "QUYET_DINH", "THONG_TU": "THONG_TU", "CHI_THI": "THONG_TU", "TO_TRINH": "THONG_TU", "THONG_BAO": "THONG_TU", "CONG_VAN": "THONG_TU", "QCVN": "KY_THUAT", "TCVN": "KY_THUAT", "VB_HOP_NHAT": "VB_HOP_NHAT"}
LOCAL = ("UBND", "HĐND", "HDND")
DISCIPLINES = (("BXD", "XAY_DUNG"), ("BTNMT", "MOI_TRUONG"), ("BGTVT", "GIAO_THONG"), ("BTP", "TU_PHAP"), ("BTC", "TAI_CHINH"), ("BKHĐT|BKHDT", "DAU_TU"), ("BLĐTBXH|BLDTBXH", "LAO_DONG"), ("BGDĐT|BGDDT", "GIAO_DUC"), ("BYT", "Y_TE"), ("BCT", "CONG_THUONG"), ("BNNPTNT", "NONG_NGHIEP"), ("BNV", "NOI_VU"), ("BQP", "QUOC_PHONG"), ("BCA|PCCC|CATP", "CONG_AN"), ("BTTTT", "CNTT"))
_STANDARD = r"(?:QCVN|TCVN|TCCS|QCĐP)\s+\d+[:/]\d{4}\b"
_NUMBER = r"\d{1,5}/\d{4}/[A-ZĐ\-]+\b"
INTENTS = (
    (rf"(?U)\b{_NUMBER}.*\b{_NUMBER}", "complex", 0.85, "multiple_doc_refs"),
    (rf"(?iuU)\b{_STANDARD}.*\b{_STANDARD}", "complex", 0.85, "multiple_doc_refs"),
    (rf"(?iuU)\b{_NUMBER}.*\b{_STANDARD}|\b{_STANDARD}.*\b{_NUMBER}", "complex", 0.85, "multiple_doc_refs"),
    (r"(?iuU)\b(?:so sánh|khác nhau|giống nhau|phân biệt|đối chiếu)\b", "complex", 0.85, "comparison_keyword"),
    (r"(?iuU)\b(?:mâu thuẫn|xung đột|không nhất quán|chồng chéo)\b", "complex", 0.85, "conflict_keyword"),
    (r"(?U)\b\d{1,5}/\d{4}/(?:NĐ|TT|QĐ|CV|CT|KH|BT|HD|NQ)-[A-ZĐa-z]{2,10}\b", "exact", 0.9, "doc_number_with_year"),
    (r"(?U)\b\d{1,5}/(?:QĐ|NQ|CT|CV)-[A-ZĐa-z]{2,10}\b", "exact", 0.9, "doc_number_no_year"),
    (rf"(?iuU)\b{_STANDARD}", "exact", 0.9, "technical_standard_code"),
    (r"(?iuU)\b(?:Điều|Khoản|Điểm|Chương|Mục|Phần)\s+\d+\b", "exact", 0.9, "article_reference"),
    (r'"[^"]{5,80}"', "exact", 0.9, "quoted_exact_term"),
    (r"(?iuU)\b(?:thay thế|sửa đổi|bổ sung|ban hành mới|còn hiệu lực|hết hiệu lực)\b", "complex", 0.85, "amendment_keyword"),
    (r"(?iuU)\b(?:trước|sau)\s+(?:ngày|tháng|năm\s+\d{4}|thời điểm|khi có hiệu lực)\b", "complex", 0.85, "timeline_keyword"),
    (r"(?iuU)\b(?:từ năm|đến năm)\s+\d{4}\b", "complex", 0.85, "timeline_keyword"),
    (r"(?iuU)\b(?:lịch sử|tiến trình|timeline)\b", "complex", 0.85, "timeline_keyword"),
)


def first_match(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first condition that holds."""
    out = F.when(*rules[0])
    for cond, value in rules[1:]:
        out = out.when(cond, value)
    return out.otherwise(default)


def document_type(number: Column, file_name: Column, head: Column) -> Column:
    def by_parts(source: Column) -> Column:
        up = F.upper(source)
        rules = [(F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(up, p)), F.lit(t)) for parts, t in DOC_TYPES]
        rules.append((source.rlike(r"TB\d"), F.lit("THONG_BAO")))
        return F.when(F.length(source) > 0, first_match(rules, F.lit(None).cast("string")))

    stem = F.substring_index(F.element_at(F.split(file_name, "/"), -1), ".", 1)
    by_name = first_match([(stem.rlike("(?iu)^" + p), F.lit(t)) for p, t in NAME_TYPES], F.lit(None).cast("string"))
    return F.coalesce(by_parts(number), by_parts(file_name), by_parts(F.substring(head, 1, 300)), by_name, F.lit("VAN_BAN"))


def legal_level(doc_type: Column, authority: Column) -> Column:
    level = F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), doc_type)
    local = F.upper(F.coalesce(authority, F.lit(""))).rlike("|".join(LOCAL))
    return F.when(local & (level.isNull() | level.isin("QUYET_DINH", "NGHI_QUYET", "THONG_TU")), "DIA_PHUONG").otherwise(F.coalesce(level, F.lit("UNKNOWN")))


def discipline(authority: Column, number: Column, file_name: Column) -> Column:
    one = lambda s: first_match([(F.upper(s).rlike(p), F.lit(d)) for p, d in DISCIPLINES], F.lit(None).cast("string"))
    return F.coalesce(one(authority), one(number), one(file_name), F.lit("TONG_HOP"))


def query_intent(query: Column) -> Column:
    """struct of intent, confidence and rule."""
    s = lambda i, c, r: F.struct(F.lit(i).alias("intent"), F.lit(c).alias("confidence"), F.lit(r).alias("rule"))
    q = F.trim(F.coalesce(query, F.lit("")))
    rules = [(q == "", s("semantic", 0.5, "empty_query"))] + [(q.rlike(p), s(i, c, r)) for p, i, c, r in INTENTS]
    return first_match(rules, s("semantic", 0.75, "default_semantic"))


def fusion_weights(intent: Column) -> Column:
    return F.when(intent == "exact", F.array(F.lit(0.3), F.lit(0.7))).when(intent == "complex", F.array(F.lit(0.7), F.lit(0.3))).otherwise(F.array(F.lit(0.6), F.lit(0.4)))


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def is_noise(text: Column) -> Column:
    t = F.trim(text)
    n = F.length(t)
    lead = r"(?iu)^(?:\[.*?\]\s*)?"
    signer = t.rlike(lead + r"(?:KT\.|TM\.|Ký thay\.?|Q\.)\s*(?:THỦ TƯỚNG|CHỦ TỊCH|BỘ TRƯỞNG|CHÍNH PHỦ|GIÁM ĐỐC)")
    archive = t.rlike(lead + r"(?:Lưu\s*:|VT\s*,)")
    header = t.rlike(lead + r"(?:CỘNG HÒA XÃ HỘI|Độc lập\s*-\s*Tự do|Số\s*:\s*[/\s\d]*[A-ZĐ]{2}|Hà Nội\s*,\s*ngày|Kính gửi\s*:)")
    return (n < 40) | ((n < 120) & signer) | ((n < 80) & archive) | ((n < 150) & header)


def without_noise(chunks: DataFrame, doc: str, text: str) -> DataFrame:
    """Chunks that are no noise; all of a document where all are."""
    k = chunks.withColumn("_noise", is_noise(F.col(text)))
    return k.withColumn("_any", F.bool_or(~F.col("_noise")).over(W.partitionBy(doc))).filter("NOT _noise OR NOT _any").drop("_noise", "_any")


def _tags_and_odd(text: Column) -> tuple[Column, Column]:
    """Counts of tags and of odd characters, looked for only in texts that can have any."""
    tags = F.when(F.contains(text, F.lit("<")), F.regexp_count(text, F.lit("</?math>|<br/?>|</?sup>"))).otherwise(0)
    odd = F.when(F.octet_length(text) > F.length(text), F.regexp_count(text, F.lit("[ŧĖΧŲġşŷįďŕŝΈΊϐ]"))).otherwise(0)
    return tags, odd


def is_garbled_table(text: Column) -> Column:
    """Short lines, table words, single marks, odd characters, tags or repetition."""
    ls = lines_of(text)
    n = F.greatest(F.size(ls), F.lit(1))
    short = F.size(F.filter(ls, lambda x: F.length(x) < 25)) / n
    marks = F.size(F.filter(ls, lambda x: x.isin("X", "Χ", "Х", "x", ".", "-", "_", "*"))) / n
    words = sum((F.contains(text, F.lit(w)).cast("int") for w in ("Vốn NĐT", "NSNN", "NSTP", "NSTW", "NSTƯ")), F.lit(0))
    tags, odd = _tags_and_odd(text)
    sample = F.trim(F.substring(text, 1, 200))
    times = (F.length(text) - F.length(F.replace(text, sample, F.lit("")))) / F.greatest(F.length(sample), F.lit(1))
    found = ((short > 0.5) & ((words >= 2) | (marks > 0.1))) | ((short > 0.7) & (marks > 0.05)) | (odd > 5) | (tags >= 3) | ((F.length(text) > 500) & (sample != "") & (times >= 3))
    return (F.length(text) >= 50) & (F.size(ls) >= 3) & found


def with_garbled_table(df: DataFrame, text: str, out: str) -> DataFrame:
    """is_garbled_table as a column, in steps: lines are cut once, and only of texts that
    are long enough."""
    x = df.withColumn(out, F.when(F.length(text) >= 50, lines_of(F.col(text))))
    ls = F.col(out)
    counts = F.struct(F.size(ls).alias("n"), F.size(F.filter(ls, lambda s: F.length(s) < 25)).alias("short"), F.size(F.filter(ls, lambda s: s.isin("X", "Χ", "Х", "x", ".", "-", "_", "*"))).alias("marks"))
    x = x.withColumn(out, F.when(F.size(ls) >= 3, counts))
    c, n = F.col(text), F.col(f"{out}.n")
    short, marks = F.col(f"{out}.short") / n, F.col(f"{out}.marks") / n
    words = sum((F.contains(c, F.lit(w)).cast("int") for w in ("Vốn NĐT", "NSNN", "NSTP", "NSTW", "NSTƯ")), F.lit(0))
    sample = F.trim(F.substring(c, 1, 200))
    again = F.contains(F.substring(c, F.lit(201), F.length(c)), F.substring(sample, 1, 20))
    times = F.when(again, (F.length(c) - F.length(F.replace(c, sample, F.lit("")))) / F.length(sample)).otherwise(1)
    tags, odd = _tags_and_odd(c)
    rare = (odd > 5) | (tags >= 3)
    found = F.when((short > 0.7) & (marks > 0.05), True).when((short > 0.5) & ((marks > 0.1) | (words >= 2)), True).when((F.length(c) > 500) & (sample != "") & (times >= 3), True).otherwise(rare)
    return x.withColumn(out, F.when(F.col(out).isNull(), False).otherwise(found))


def is_broken_table(text: Column) -> Column:
    """Pipe counts that differ and miss on a line, dot leaders or wide gaps."""
    counts = F.transform(lines_of(text), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))))
    total = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return ((total > 2) & (F.array_max(counts) != F.array_min(counts)) & (F.array_min(counts) == 0)) | text.rlike(r"\.{5,}| {5,}")


def packed_sentences(text: Column, least: int = 300) -> Column:
    """Sentences packed to at least ``least`` characters; a short tail joins the last
    pack, a tail of up to 100 characters without one is left out."""
    parts = F.filter(F.transform(F.split(text, r"(?<!\d)\.(?!\d)\s+|\n(?=[A-Z])|\n(?=\d+[.)]\s)|\n(?=[a-z]\)\s)"), lambda x: F.trim(x)), lambda x: x != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, x: Column) -> Column:
        joined = F.when(acc["buf"] == "", x).otherwise(F.concat(acc["buf"], F.lit(" "), x))
        full = F.length(joined) >= least
        return F.struct(F.when(full, F.concat(acc["done"], F.array(joined))).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(joined).alias("buf"))

    def finish(acc: Column) -> Column:
        n = F.size(acc["done"])
        last = F.concat(F.try_element_at(acc["done"], F.lit(-1)), F.lit(" "), acc["buf"])
        merged = F.concat(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(last))
        return F.when(acc["buf"] == "", acc["done"]).when((n > 0) & (F.length(acc["buf"]) < least // 2), merged).when(F.length(acc["buf"]) > 100, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"])

    return F.aggregate(parts, zero, step, finish)


def merged_segments(texts: Column, least: int = 300) -> Column:
    """Segments merged until a block has ``least`` characters; a short tail merges back."""
    parts = F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, x: Column) -> Column:
        full = F.length(acc["buf"]) >= least
        buf = F.when((acc["buf"] == "") | full, x).otherwise(F.concat(acc["buf"], F.lit("\n"), x))
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]).alias("done"), buf.alias("buf"))

    def finish(acc: Column) -> Column:
        n = F.size(acc["done"])
        last = F.concat(F.try_element_at(acc["done"], F.lit(-1)), F.lit("\n"), acc["buf"])
        short = (n > 0) & (F.length(acc["buf"]) < least // 2)
        return F.when(acc["buf"] == "", acc["done"]).when(short, F.concat(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(last))).otherwise(F.concat(acc["done"], F.array(acc["buf"])))

    return F.aggregate(parts, zero, step, finish)


def fallback_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A parent and packed children of texts over 300 characters; one chunk over 30."""
    kids = F.when(F.length(text) > 300, packed_sentences(F.col(text))).otherwise(F.array().cast("array<string>"))
    parent = F.struct(F.lit("parent").alias("chunk_type"), F.lit(0).alias("n"), F.col(text).alias("chunk"))
    rows = F.concat(F.array(parent), F.transform(kids, lambda x, i: F.struct(F.lit("child").alias("chunk_type"), (i + 1).alias("n"), x.alias("chunk"))))
    return docs.filter(F.length(text) > 30).select(key, F.inline(rows))


def marked_sections(docs: DataFrame, key: str, text: str, marker: str) -> DataFrame:
    """Text from each marker line to the next, numbered; 0 is what stands before."""
    parts = F.split(F.col(text), rf"(?m)(?={marker})")
    return docs.select(key, F.posexplode(parts).alias("n", "section")).filter(F.trim("section") != "")


def short_pages(pages: DataFrame, doc: str, page: str, text: str, share: float = 0.25) -> DataFrame:
    """Pages below a share of the document's upper median length; three pages at least
    and a median of 100."""
    lens = F.array_sort(F.collect_list(F.length(text)))
    g = pages.groupBy(doc).agg(lens.alias("l")).filter(F.size("l") >= 3).select(doc, F.element_at("l", (F.floor(F.size("l") / 2) + 1).cast("int")).alias("median")).filter("median >= 100")
    return pages.join(g, doc).filter(F.length(text) < share * F.col("median")).select(doc, page)


def text_audit(docs: DataFrame, text: str) -> DataFrame:
    """Issue counts over documents and the score max(0, floor(100 - 400 * sum / (n k)))."""
    t = F.col(text)
    issues = {"empty": F.length(F.trim(t)) == 0, "garbled": is_garbled_table(t), "broken_table": is_broken_table(t), "noise": is_noise(t), "replacement": F.contains(t, F.lit("�")), "tags": t.rlike("<[a-z]+>"), "wide": t.rlike(" {5,}"), "long_line": F.exists(F.split(t, "\n"), lambda x: F.length(x) > 2000)}
    agg = docs.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in issues.items()])
    total = sum((F.col(k) for k in issues), F.lit(0))
    return agg.withColumn("score", F.greatest(F.lit(0), F.floor(100 - 400 * total / F.greatest(F.col("n") * len(issues), F.lit(1)))).cast("int"))


def chunk_audit(chunks: DataFrame) -> DataFrame:
    """Counts, ratio and lengths of chunks, and duplicates beyond the first."""
    dup = chunks.groupBy("chunk").agg((F.count("*") - 1).alias("extra")).agg(F.sum("extra").alias("duplicates"))
    n = chunks.agg(F.count_if(F.col("chunk_type") == "parent").alias("parents"), F.count_if(F.col("chunk_type") == "child").alias("children"), F.min(F.length("chunk")).alias("min_len"), F.max(F.length("chunk")).alias("max_len"), F.avg(F.length("chunk")).alias("mean_len"), F.median(F.length("chunk")).alias("median_len"))
    return n.join(F.broadcast(dup)).withColumn("ratio", F.col("children") / F.greatest(F.col("parents"), F.lit(1)))


def claim(store: KeyedStore, files: DataFrame, stale: float = 120.0) -> list[int]:
    """Claims files (key, owner, claimed_at) in a store with status and retries: what is new,
    pending, failed with retries left, or claimed so long ago that it is stale. Of a file that
    another worker holds nothing changes. Returns the folders that were written."""
    s = F.col("held.status")
    ok = F.coalesce((s == "PENDING") | ((s == "FAILED") & (F.col("held.retries") < 3)) | ((s == "CLAIMED") & (F.col("held.claimed_at") < F.col("new.claimed_at") - stale)), F.col("held").isNull())
    take = {c: F.when(ok, F.col(f"new.{c}")).otherwise(F.col(f"held.{c}")) for c in ("owner", "claimed_at")}
    return store.upsert(files, take | {"status": F.when(ok, "CLAIMED").otherwise(s), "retries": F.coalesce("held.retries", F.lit(0))})


def collision_free_ids(rows: DataFrame, doc_id: str, path: str) -> DataFrame:
    """Later rows of one doc_id get ``_DUP_`` and six digits of the path's md5."""
    n = F.row_number().over(W.partitionBy(doc_id).orderBy(path))
    return rows.withColumn("_n", n).withColumn("unique_id", F.when(F.col("_n") > 1, F.concat(F.col(doc_id), F.lit("_DUP_"), F.substring(F.md5(F.col(path).cast("binary")), 1, 6))).otherwise(F.col(doc_id))).drop("_n")


def checkpoint_due(count: DataFrame, last: DataFrame, step: int = 50) -> DataFrame:
    """Whether count passed last + step, and the new checkpoint. One row each."""
    x = count.join(F.broadcast(last), how="left")
    l0 = F.coalesce("last", F.lit(0))
    return x.select("n", (F.col("n") >= l0 + step).alias("due"), (F.floor(F.col("n") / step) * step).cast("long").alias("checkpoint"))


def heuristic_entailment(rows: DataFrame) -> DataFrame:
    """premise, hypothesis to probabilities of entailment, neutrality, contradiction."""
    from lexiquarry.functions import text as t

    p, h = F.col("premise"), F.col("hypothesis")
    r = rows.withColumns({"rel": t.measure_relation(p, h), "pt": t.content_tokens(p), "ht": t.content_tokens(h), "pp": t.polarity(p), "hp": t.polarity(h)})
    r = r.withColumn("recall", t.token_recall(F.col("ht"), F.col("pt")))
    clash = (F.col("rel") == "conflict") | ((F.col("pp") * F.col("hp") == -1) & (F.col("recall") >= 0.5))
    covers = (F.col("recall") >= 0.8) & ((F.size("ht") >= 4) | ((F.size("ht") >= 2) & (F.size("pt") <= F.size("ht") + 3)))
    three = lambda e, n, c: F.array(e, n, c)
    entail = F.least(F.lit(0.95), 0.78 + 0.17 * F.col("recall"))
    partial = 0.35 + 0.35 * F.col("recall")
    probs = (
        F.when(t.squash(h) == "", three(F.lit(0.05), F.lit(0.9), F.lit(0.05)))
        .when(clash, three(F.lit(0.04), F.lit(0.08), F.lit(0.88)))
        .when(F.col("rel") == "unsupported", three(F.lit(0.18), F.lit(0.74), F.lit(0.08)))
        .when(covers, three(entail, 1.0 - entail - 0.03, F.lit(0.03)))
        .when(F.col("recall") < 0.35, three(F.lit(0.12), F.lit(0.8), F.lit(0.08)))
        .otherwise(three(partial, 1.0 - partial - 0.08, F.lit(0.08)))
    )
    r = r.withColumn("probs", probs)
    status = F.when(F.col("probs")[2] >= 0.8, "rejected_contradiction").when(F.col("probs")[0] >= 0.75, "verified_entailment").otherwise("unverified")
    return r.withColumn("status", status).drop("rel", "pt", "ht", "pp", "hp")
