"""Maintenance of an index: recovery, checks, identifiers, numbered sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.functions.text import dedup_paragraphs

# Words and patterns that results must equal.
ENGLISH = "the this that is are was which appears based document article regarding content text following decision regulation law chapter section point however therefore according pertaining related address establish implement provide specify include require".split()
UNITS = (r"[≤≥±]", r"m[²³]", "kN/m", "kg/m", r"dB[Am]?", "MHz|GHz|kHz")
HEADERS = ("STT", "Đơn vị", "ĐVT", "Quy cách", "Kích thước", "Tỷ lệ")
FILE_TYPES = {"QD": "QĐ", "ND": "NĐ", "CD": "CĐ"}
ODD = "[ŧĖΧŲġşŷįďŕŝΈΊϐ]"
_SAFE = r"[^\p{L}\p{M}\p{N}_\-/.]"


def table_text_clean(c: Column) -> Column:
    x = F.regexp_replace(dedup_paragraphs(c), r"(?m)^\s*\d{1,3}\s*$", "")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def recoverable(c: Column) -> Column:
    """After dedup: 50 characters, two lines, at most five odd characters."""
    x = dedup_paragraphs(c)
    lines = F.size(F.filter(F.split(x, "\n"), lambda s: F.trim(s) != ""))
    return (F.length(x) >= 50) & (lines >= 2) & (F.regexp_count(x, F.lit(ODD)) <= 5)


def is_english(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(ENGLISH) + r")(?![A-Za-z0-9_])")) > 5


def table_signals(c: Column) -> Column:
    """Two kinds of units or two header words."""
    units = sum((c.rlike(p).cast("int") for p in UNITS), F.lit(0))
    heads = sum((F.contains(c, F.lit(h)).cast("int") for h in HEADERS), F.lit(0))
    return (units >= 2) | (heads >= 2)


def fragmented_line(c: Column) -> Column:
    x = F.trim(c)
    return (x != "") & (F.length(x) <= 60) & (x.rlike(r"^[\d.,\s%+\-/]+$") | ((F.size(F.split(x, r"\s+")) <= 2) & x.rlike(r"\d")))


def number_from_path(path: Column) -> Column:
    """QCVN and law names, TYPE + number - year - authority, TYPE + number - authority."""
    b = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.json|\.md|\.bak)+$", "")
    types = F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])
    q, w, n, s = r"QCVN[-_ ]?(\d+)[-_:](\d{4})[-_/]([A-Z]+)", r"Luat_(\d+)-(\d{4})-QH(\d+)", r"([A-Z]{2,4})(\d+)[-_/](\d{4})[-_/]([A-Za-z]+)", r"([A-Z]{2,4})(\d+)[-_/]([A-Za-z]+)"
    e = lambda p, k: F.regexp_extract(b, p, k)
    kind = lambda p: F.coalesce(F.try_element_at(types, e(p, 1)), e(p, 1))
    return (
        F.when(b.rlike(q), F.concat(F.lit("QCVN "), e(q, 1), F.lit(":"), e(q, 2), F.lit("/"), e(q, 3)))
        .when(b.rlike(w), F.concat(e(w, 1), F.lit("/"), e(w, 2), F.lit("/QH"), e(w, 3)))
        .when(b.rlike(n), F.concat(e(n, 2), F.lit("/"), e(n, 3), F.lit("/"), kind(n), F.lit("-"), e(n, 4)))
        .when(b.rlike(s), F.concat(e(s, 2), F.lit("/"), kind(s), F.lit("-"), e(s, 3)))
    )


def canonical_by_prefix(number: Column, slug: Column) -> Column:
    plain = number.rlike(r"^\d+/") | number.rlike("(?i)^(?:QCVN|TCVN|TCXD|TCXDVN|APPENDIX|PL)")
    return F.when(plain, F.regexp_replace(F.concat(F.lit("VBPL/"), number), _SAFE, "_")).otherwise(F.concat(F.lit("VBPL/"), F.replace(slug, F.lit(" "), F.lit("_"))))


def fenced_xml(c: Column) -> Column:
    """From the start of XML on, in a fence."""
    at = F.regexp_instr(c, F.lit(r"<\?xml|<[a-zA-Z]+:[a-zA-Z]+[ >]"))
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit("```xml\n"), F.substring(c, at, F.length(c)), F.lit("\n```"))).otherwise(c)


def numbered_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sections that start with a number, of texts with two at least and no articles."""
    parts = F.split(F.col(text), r"(?m)(?=^\d+(?:\.\d+)*\.?\s+\p{Lu})")
    p = docs.filter(~F.col(text).rlike(r"(?m)^Điều\s+\d+")).select(key, F.filter(parts, lambda x: F.trim(x) != "").alias("parts"))
    starts = F.filter("parts", lambda x: x.rlike(r"^\d"))
    return p.filter(F.size(starts) >= 2).select(key, F.posexplode("parts").alias("n", "section"))


def form_fields(docs: DataFrame, key: str, text: str, indicators: str) -> DataFrame:
    """Fields of forms: three at least, two with an indicator; fields over 30 characters."""
    f = docs.select(key, F.split(text, r"(?m)(?=^\d+\.(?:\d+\.)*\s)").alias("f"))
    f = f.filter((F.size("f") >= 3) & (F.size(F.filter("f", lambda x: x.rlike(indicators))) >= 2))
    return f.select(key, F.posexplode("f").alias("n", "field")).filter(F.length(F.trim("field")) >= 30)


def forward_merged(parts: Column, least: int = 80) -> Column:
    """A short part joins the one after it; of two short ones the first is lost."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, x: Column) -> Column:
        short = F.length(x) < least
        joined = F.when(acc["buf"] == "", x).otherwise(F.concat(acc["buf"], F.lit("\n"), x))
        return F.struct(F.when(short, acc["done"]).otherwise(F.concat(acc["done"], F.array(joined))).alias("done"), F.when(short, x).otherwise(F.lit("")).alias("buf"))

    return F.aggregate(F.filter(parts, lambda x: F.trim(x) != ""), zero, step, lambda a: a["done"])


def placeholder_recovered(pages: DataFrame, chunks: DataFrame, mark: str) -> DataFrame:
    """Placeholder pages (doc, page, text) replaced by their chunks' texts, where there are any."""
    c = chunks.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n").alias("found"))
    return pages.join(c, ["doc", "page"], "left").withColumn("text", F.when(F.contains("text", F.lit(mark)) & F.col("found").isNotNull(), F.col("found")).otherwise(F.col("text"))).drop("found")


def better_chunking(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose new chunking has more children."""
    n = lambda df, c: df.filter("chunk_type = 'child'").groupBy(key).agg(F.count("*").alias(c))
    return n(new, "new").join(n(old, "old"), key, "left").withColumn("old", F.coalesce("old", F.lit(0))).filter("new > old")


def report_scores(text: Column) -> Column:
    """name to score of ``name: 12/100`` lines."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^\W*(\w+)\W*:\W*(\d+)/100"), F.lit(0))
    pair = lambda x: F.struct(F.lower(F.regexp_extract(x, r"(\w+)", 1)).alias("k"), F.regexp_extract(x, r"(\d+)/100", 1).cast("int").alias("v"))
    return F.map_from_entries(F.transform(lines, pair))


def flagged(rows: DataFrame, key: str, score: str, text: str, least: float) -> DataFrame:
    """Keys whose five best scores have a mean below ``least``, with three texts."""
    # Ranked before they are gathered, so a key's other rows stay where they are.
    order = W.partitionBy(key).orderBy(F.col(score).desc_nulls_last(), F.col(text).desc_nulls_last())
    best = rows.select(key, score, text, F.row_number().over(order).alias("_n")).filter("_n <= 5")
    g = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", score, text))).alias("top"))
    mean = F.aggregate(F.transform("top", lambda x: x[score]), F.lit(0.0), lambda a, x: a + x) / F.size("top")
    return g.withColumn("mean", mean).filter(F.col("mean") < least).select(key, "mean", F.transform(F.slice("top", 1, 3), lambda x: F.substring(x[text], 1, 500)).alias("texts"))
