"""Chunking: a chain of strategies, layouts, merged exports and table summaries.

A strategy is a column expression from a text to an array of chunks, empty where it does
not apply; it can also be any table function of the caller's (see hooks.custom_chunks).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.operators.documents import merged_segments

Strategy = Callable[[Column], Column]

# How parts of legal texts start, in the order in which they are tried.
ARTICLE = r"(^|\n)(Điều[ \t]+[0-9]+[.:])"
NUMBERED = r"(^|\n)([0-9]{1,2}\.[0-9]{1,2}\.?[ \t])"
SECTION = r"(^|\n)((?:Chương|CHƯƠNG|Mục|MỤC|Phần|PHẦN)[ \t]+[IVX0-9]+)"
FIELD = r"(^|\n)([^\n:]{2,40}:[ \t])"
LEAST_NOISE = 40
LEAST_PARENT = 100


def parts_from(marker: str, least: int) -> Strategy:
    """From each start to the next, where a text has ``least`` starts; what stands before
    the first is a part too."""

    def cut(text: Column) -> Column:
        parts = F.split(F.regexp_replace(text, marker, "\u0001$2"), "\u0001")
        kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
        return F.when(F.regexp_count(text, F.lit(marker)) >= least, kept).otherwise(F.array().cast("array<string>"))

    return cut


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


#: Article, numbered section, section, form, and paragraphs for all else.
CHAIN: tuple[tuple[str, Strategy], ...] = (
    ("article", parts_from(ARTICLE, 1)),
    ("numbered", parts_from(NUMBERED, 2)),
    ("section", parts_from(SECTION, 1)),
    ("form", parts_from(FIELD, 3)),
    ("fallback", paragraphs),
)


def chain_chunks(docs: DataFrame, key: str, text: str, chain: tuple[tuple[str, Strategy], ...] = CHAIN) -> DataFrame:
    """key, strategy, n, chunk of the first strategy that gives chunks. Short chunks go,
    unless all of a text's are."""
    kept = lambda c: F.when(F.exists(c, lambda x: F.length(x) >= LEAST_NOISE), F.filter(c, lambda x: F.length(x) >= LEAST_NOISE)).otherwise(c)
    each = docs.select(key, F.array(*[F.struct(F.lit(name).alias("strategy"), f(F.col(text)).alias("chunks")) for name, f in chain]).alias("all"))
    first = each.select(key, F.try_element_at(F.filter("all", lambda s: F.size(s["chunks"]) > 0), F.lit(1)).alias("x"))
    return first.select(key, "x.strategy", F.posexplode(kept(F.col("x.chunks"))).alias("n", "chunk"))


def layout_chunks(segments: DataFrame, key: str, n: str, text: str, is_table: Column, least: int = 300) -> DataFrame:
    """key, kind, n, chunk of pages of segments: tables for themselves, the rest by articles
    or sections if it has any, else merged to blocks of ``least`` characters."""
    s = segments.select(key, F.struct(F.col(n).alias("n"), F.trim(text).alias("text")).alias("seg"), is_table.alias("is_table"))
    pages = s.groupBy(key).agg(F.array_sort(F.collect_list(F.when(~F.col("is_table"), F.col("seg")))).alias("texts"), F.array_sort(F.collect_list(F.when(F.col("is_table"), F.col("seg")))).alias("tables"))
    texts = F.filter(F.transform("texts", lambda x: x["text"]), lambda x: x != "")
    pages = pages.select(key, texts.alias("texts"), F.filter(F.transform("tables", lambda x: x["text"]), lambda x: x != "").alias("tables"))
    pages = pages.withColumn("whole", F.array_join("texts", "\n"))
    size = F.length("whole")
    article, section = parts_from(ARTICLE, 1)(F.col("whole")), parts_from(SECTION, 1)(F.col("whole"))
    blocks = F.when((size > 80) & (F.size(article) > 0), article).when((size > 200) & (F.size(section) > 0), section).otherwise(merged_segments(F.col("texts"), least))
    rows = [pages.select(key, F.lit("text").alias("kind"), F.posexplode(blocks).alias("n", "chunk")), pages.select(key, F.lit("table").alias("kind"), F.posexplode("tables").alias("n", "chunk"))]
    return reduce(DataFrame.unionByName, rows)


def rechunked(chunks: DataFrame, key: str, n: str, text: str) -> DataFrame:
    """An export's parents in page order, without their ``[id]`` prefixes, as one text that
    goes through the chain again; parents under ``LEAST_PARENT`` characters go."""
    bare = F.regexp_replace(text, r"^\[[^\]\n]*\]\s*", "")
    each = F.array_sort(F.collect_list(F.struct(F.col(n).alias("n"), bare.alias("text"))))
    merged = chunks.groupBy(key).agg(F.array_join(F.transform(each, lambda x: x["text"]), "\n").alias("text"))
    return chain_chunks(merged, key, "text").filter(F.length("chunk") >= LEAST_PARENT)


def with_table_summaries(chunks: DataFrame, text: str, is_table: Column, summarise: Callable[[Column], Column], least: int = 2000) -> DataFrame:
    """The chunks, and a row of its summary for each large table; a summary of 30 characters
    or fewer is none."""
    summary = chunks.filter(is_table & (F.length(text) >= least)).withColumn(text, summarise(F.col(text))).filter(F.length(text) > 30)
    return chunks.withColumn("chunk_type", F.lit("parent")).unionByName(summary.withColumn(text, F.concat(F.lit("[TABLE SUMMARY] "), F.col(text))).withColumn("chunk_type", F.lit("table_summary")))


STANDARDS = (r"QCVN\s+[0-9]+[:-][0-9]{4}(?:/[A-ZĐ]+)?", r"TCVN\s+[0-9]+[:-][0-9]{4}", r"TCCS\s+[0-9]+/[0-9]{4}(?:/[A-ZĐ]+)?", r"(?:14|22|QCĐP|QCPL)TCN\s+[0-9]+")
ISSUING = r"(?:^|\n)Điều\s+1\.\s+(?:Ban hành|Phê duyệt)|Thông tư\s+số\s+[0-9]+/[0-9]{4}/TT-|Quyết định\s+số\s+[0-9]+/[0-9]{4}/Q[ĐD]-|Thời gian ký\s*:\s*[0-9]{2}\.[0-9]{2}\.[0-9]{4}"
CONTENT = r"(?:^|\n)(?:Lời nói đầu\s*(?:\n|$)|1\.\s+QUY ĐỊNH CHUNG\s*(?:\n|$)|CHƯƠNG\s+I[.\s]|Phần\s+(?:I|1)[.\s]|I\.\s+QUY ĐỊNH)"
SCAN_PAGES = 8


def detected_standard(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """The first standard named in a document's first pages, patterns in order; null if none."""
    each = F.array_sort(F.collect_list(F.struct(F.col(page).alias("n"), F.col(text).alias("text"))))
    head = pages.filter(F.col("at") <= SCAN_PAGES) if "at" in pages.columns else pages.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(page))).filter(F.col("at") <= SCAN_PAGES)
    scan = head.groupBy(key).agg(F.array_join(F.transform(each, lambda x: x["text"]), "\n").alias("scan"))
    found = [F.nullif(F.regexp_extract("scan", f"(?iu){p}", 0), F.lit("")) for p in STANDARDS]
    return scan.select(key, F.trim(F.coalesce(*found)).alias("standard"))


def content_starts(pages: DataFrame, key: str, page: str, text: str, is_contents: Column) -> DataFrame:
    """The page (from 0, by order) where a document's content starts: after its last issuing
    page (of the first eight) the first that has a content mark and is no table of contents;
    else the first page from there that names a standard without being an issuing one; else 0."""
    each = Window.partitionBy(key)
    p = pages.select(key, (F.row_number().over(each.orderBy(page)) - 1).alias("i"), F.col(text).rlike(f"(?iu){ISSUING}").alias("issuing"), F.col(text).rlike(f"(?iu){CONTENT}").alias("content"), is_contents.alias("toc"), F.col(text).rlike(f"(?iu){'|'.join(STANDARDS)}").alias("names"))
    p = p.withColumn("last", F.coalesce(F.max(F.when(F.col("issuing") & (F.col("i") < SCAN_PAGES), F.col("i"))).over(each), F.lit(-1)))
    second = F.min(F.when((F.col("i") > F.col("last")) & F.col("content") & ~F.col("toc"), F.col("i")))
    third = F.min(F.when((F.col("i") >= F.greatest("last", F.lit(0))) & F.col("names") & ~F.col("issuing"), F.col("i")))
    return p.groupBy(key).agg(F.coalesce(second, third, F.lit(0)).alias("start"))


SUMMARY_MARKS = (r"^1\.\s+QUY ĐỊNH CHUNG", r"^Điều\s+1\.", r"^I\.\s+QUY ĐỊNH", r"^Lời nói đầu")


def summary_windows(docs: DataFrame, key: str, text: str, most: int = 12000) -> DataFrame:
    """The part of a text to summarise: from the first mark (in order of marks) that stands
    behind 50 characters, within 60% of the text, and not before a line of contents; without
    one, long texts skip the lesser of 3000 characters and a fifth."""
    lines = docs.select(key, F.length(text).alias("size"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    order = Window.partitionBy(key).orderBy("n")
    lines = lines.withColumns({"at": F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "after": F.coalesce(F.lead("line").over(order), F.lit(""))})
    rank = reduce(lambda c, kv: F.when(F.col("line").rlike(f"(?iu){kv[1]}"), kv[0]).otherwise(c), reversed(list(enumerate(SUMMARY_MARKS))), F.lit(None).cast("int"))
    good = (F.col("at") >= 50) & (F.col("at") <= F.col("size") * 0.6) & ~F.col("after").rlike(r"^\s*1\.1\.")
    found = lines.withColumn("rank", F.when(good, rank)).filter("rank is not null").groupBy(key).agg(F.min(F.struct("rank", "at")).alias("m"))
    skip = F.when(F.length(text) > 4000, F.least(F.lit(3000), F.floor(F.length(text) / 5))).otherwise(0)
    start = F.coalesce(F.col("m.at"), skip).cast("int")
    return docs.join(found, key, "left").select(key, start.alias("start"), F.substring(text, start + 1, F.lit(most)).alias("text"))
