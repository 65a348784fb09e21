"""References, page tiers, table checks, section anchors and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.functions.text import fold, integer_token, squash
from lexiquarry.operators.documents import is_garbled_table
from lexiquarry.sources.keyed_store import KeyedStore

# Patterns that results must equal.
STANDARD = r"(?iu)(?<![\p{L}\p{N}_])(QCVN|TCVN|TCCS|QCĐP|QCDP)\s*(\d+)\s*[:/]\s*(\d{4})"
LEGAL = r"(?iu)(?<![\p{L}\p{N}_])(\d{1,5})\s*/\s*(\d{4})\s*/\s*(NĐ|ND|TT|QĐ|QD|CV|CT|KH|BT|HD|NQ)\s*-\s*([A-Za-zĐđ0-9]{2,12})"
ARTICLE, CLAUSE = r"(?iu)(?:Điều|Dieu)\s+(\d+)", r"(?iu)(?:khoản|khoan)\s+(\d+)"


def references(text: Column) -> Column:
    """Distinct ``family number:year`` of standards and legal documents in a text."""
    one = lambda pattern, make: F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), make)

    def standard(x: Column) -> Column:
        return F.concat(fold(F.regexp_extract(x, STANDARD, 1)), F.lit(" "), integer_token(F.regexp_extract(x, STANDARD, 2)), F.lit(":"), F.regexp_extract(x, STANDARD, 3))

    def legal(x: Column) -> Column:
        return F.concat(fold(F.regexp_extract(x, LEGAL, 3)), F.lit(" "), integer_token(F.regexp_extract(x, LEGAL, 1)), F.lit(":"), F.regexp_extract(x, LEGAL, 2))

    return F.array_distinct(F.concat(one(STANDARD, standard), one(LEGAL, legal)))


def numbers(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), integer_token))


def identifier_check(rows: DataFrame) -> DataFrame:
    """claim against doc_number and hierarchy_path: mismatch, pointer or null (go on)."""
    c = squash(F.col("claim"))
    r = rows.withColumns({"cr": references(c), "dr": references(F.col("doc_number")), "ca": numbers(c, ARTICLE), "ha": numbers(F.col("hierarchy_path"), ARTICLE), "cc": numbers(c, CLAUSE), "hc": numbers(F.col("hierarchy_path"), CLAUSE)})
    last = lambda k: F.try_element_at(F.col(k), F.lit(-1))
    off = lambda a, h: (F.size(a) > 0) & last(h).isNotNull() & ~F.array_contains(a, last(h))
    conflict = ((F.size("cr") > 0) & (F.size("dr") > 0) & ~F.arrays_overlap("cr", "dr")) | F.coalesce(off("ca", "ha"), F.lit(False)) | F.coalesce(off("cc", "hc"), F.lit(False))
    bare = c
    for p in (STANDARD + r"(?:\s*/\s*[A-Za-zĐđ]{2,12})?", LEGAL, ARTICLE, CLAUSE):
        bare = F.regexp_replace(bare, p, " ")
    words = F.filter(F.split(F.regexp_replace(fold(bare), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) > 1) & ~w.isin("theo", "quy", "dinh", "tai", "xem", "cua", "va", "thong", "tu", "nghi", "quyet", "luat", "so"))
    named = (F.size("cr") > 0) | (F.size("ca") > 0) | (F.size("cc") > 0)
    pointer = named & (F.size(words) == 0)
    confirmed = ((F.size("cr") == 0) | F.coalesce(F.arrays_overlap("cr", "dr"), F.lit(False))) & ((F.size("ca") == 0) | last("ha").isNotNull()) & ((F.size("cc") == 0) | last("hc").isNotNull())
    status = F.when(conflict, "rejected_mismatch").when(pointer & confirmed, "verified_pointer").when(pointer, "unverified")
    return r.withColumn("tier0", status).drop("cr", "dr", "ca", "ha", "cc", "hc")


def proposition(claim: Column) -> Column:
    """A claim without up to three leading citations and without bracketed ones."""
    x = squash(claim)
    for _ in range(3):
        x = F.regexp_replace(x, r"(?iu)^\s*(?:theo(?:\s+quy\s+định\s+tại)?|căn\s+cứ(?:\s+vào)?)\s+[^,;]*(?:Điều|khoản|QCVN|TCVN|/NĐ-|/TT-)[^,;]*[,;]\s*(?=\S)", "")
    x = F.regexp_replace(x, r"\([^()]*(?:Điều|khoản|QCVN|TCVN|/NĐ-|/TT-)[^()]*\)", " ")
    return F.regexp_replace(squash(x), r"[\s,;:.\-]+$", "")


def softmax3(logits: Column, order: tuple[int, int, int]) -> Column:
    """Stable softmax of three logits, put in the given order."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.array(*[e[i] / total for i in order])


def page_tier(chars: Column, images: Column, short_share: Column) -> Column:
    """NATIVE with text and sound spacing; scans by the number of images."""
    return F.when((chars >= 100) & (short_share <= 0.3), "NATIVE").when(images > 1, "SCAN_COMPLEX").otherwise("SCAN_SIMPLE")


def ocr_quality(confidence: Column, is_table: Column, first: Column, last: Column, keywords: Column) -> Column:
    """100 * confidence, - 20 for a table, + 15 / + 10 at the ends, + 5 a keyword, in 0..100."""
    s = 100 * confidence - F.when(is_table, 20).otherwise(0) + F.when(first, 15).otherwise(0) + F.when(last, 10).otherwise(0) + 5 * keywords
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), s))


def is_markdown_table(text: Column) -> Column:
    return text.rlike(r"\|.*\|.*\n\|[-:\s|]+\|")


def is_table(text: Column, flagged: Column) -> Column:
    return flagged | is_markdown_table(text) | is_garbled_table(text)


def is_contents_page(text: Column) -> Column:
    """Three or more lines with leaders or a trailing page number, over 30 % of lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    toc = F.size(F.filter(lines, lambda x: x.rlike(r"(?:\.{3,}|\s{3,})\s*\d{1,4}\s*$")))
    return (toc >= 3) & (toc > 0.3 * F.size(lines))


def broken_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of two or more pipe rows whose second is no separator: gaps and islands."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("row", F.trim("line").rlike(r"^\|.*\|$"))
    w = W.partitionBy(key).orderBy("pos")
    rows = lines.withColumn("grp", F.col("pos") - F.row_number().over(W.partitionBy(key, "row").orderBy("pos"))).filter("row")
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy(key, "grp").orderBy("pos")))
    g = rows.groupBy(key, "grp").agg(F.count("*").alias("n"), F.bool_or((F.col("k") == 2) & F.col("line").rlike(r"^\s*\|[\s\-:|]+\|\s*$")).alias("sound"))
    return g.filter("n >= 2 AND NOT sound").groupBy(key).agg(F.count("*").alias("broken"))


def from_content(pages: DataFrame, doc: str, page: str, text: str, marker: str) -> DataFrame:
    """Pages from the first one with the marker; all of a document without it."""
    start = F.min(F.when(F.col(text).rlike(marker), F.col(page))).over(W.partitionBy(doc))
    return pages.withColumn("_s", start).filter(F.col("_s").isNull() | (F.col(page) >= F.col("_s"))).drop("_s")


def heading_of(path: Column) -> Column:
    """Markdown heading of a path's last part, its level by its numbering's depth."""
    last = F.trim(F.element_at(F.split(path, "->"), -1))
    n = F.regexp_extract(last, r"^(\d+(?:\.\d+)*)", 1)
    level = F.when(n == "", 2).otherwise(F.least(F.lit(6), F.size(F.split(n, r"\.")) + 1))
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.substring(last, 1, 80))


def parent_clause(clause: Column) -> Column:
    """d5-p2 belongs to d5; 1-2-3 belongs to 1-2."""
    return F.when(clause.rlike(r"^d\d+-p\d+$"), F.regexp_extract(clause, r"^(d\d+)-", 1)).when(clause.rlike(r"^\d+(?:-\d+)+$"), F.regexp_extract(clause, r"^(.*)-\d+$", 1))


def json_in_text(text: Column) -> Column:
    """The fenced block, or the last object without nesting, that parses; else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    objects = F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1))
    tries = F.concat(F.array(fenced), F.reverse(objects))
    return F.try_element_at(F.filter(tries, lambda x: F.try_parse_json(x).isNotNull() & (x != "")), F.lit(1))


def anchored_chunks(docs: DataFrame, key: str, text: str, marker: str, most: int, part: int) -> DataFrame:
    """Spans between marker lines; those over ``most`` characters in parts of ``part``."""
    spans = docs.select(key, F.posexplode(F.split(text, rf"(?m)(?={marker})")).alias("n", "s")).filter(F.trim("s") != "")
    count = F.when(F.length("s") > most, F.ceil(F.length("s") / part)).otherwise(1).cast("int")
    rows = spans.withColumn("k", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("parts", count)
    chunk = F.when(F.col("parts") > 1, F.substring(F.col("s"), F.col("k") * part + 1, F.lit(part))).otherwise(F.col("s"))
    name = F.concat(F.col(key).cast("string"), F.lit("::p1::"), F.col("n").cast("string"), F.when(F.col("parts") > 1, F.concat(F.lit("::part"), (F.col("k") + 1).cast("string"))).otherwise(""))
    return rows.select(key, name.alias("chunk_id"), chunk.alias("chunk"))


def version_update(status: KeyedStore, edges: KeyedStore, versions: DataFrame) -> None:
    """Tells the stores of new versions (new, supersedes, amends; nulls: none): what is superseded
    becomes SUPERSEDED, what is amended OUTDATED unless it is superseded, and each gets an
    edge. status holds (id, status), edges (key, src, rel, dst). Telling it again changes nothing."""
    pair = lambda rel, column: F.when(F.col(column).isNotNull(), F.struct(F.lit(rel).alias("rel"), F.col(column).alias("dst")))
    said = versions.select(F.col("new").alias("src"), F.inline(F.array_compact(F.array(pair("SUPERSEDES", "supersedes"), pair("AMENDS", "amends")))))
    hit = said.groupBy(F.col("dst").alias("id")).agg(F.when(F.bool_or(F.col("rel") == "SUPERSEDES"), "SUPERSEDED").otherwise("OUTDATED").alias("status"))
    status.upsert(hit, {"status": F.when(F.col("held.status") == "SUPERSEDED", F.col("held.status")).otherwise(F.col("new.status"))})
    edges.upsert(said.select(F.concat_ws(">", F.col("src").cast("string"), "rel", F.col("dst").cast("string")).alias("key"), "src", "rel", "dst"), {})
