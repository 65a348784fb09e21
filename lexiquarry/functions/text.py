"""Text passes as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters, replacements and patterns that results must equal.
EMOJI = "🌋🔥💥⚡🌊🎯🚀🎉🏆🌟💎🎮⭐"
TYPOS = (
    ("NGHÈ", "NGHỀ"), ("Nghè", "Nghề"), ("nghè", "nghề"), ("Tỳ lệ", "Tỷ lệ"), ("tỳ lệ", "tỷ lệ"), ("hổ sơ", "hồ sơ"), ("Hổ sơ", "Hồ sơ"),
    ("bố sung", "bổ sung"), ("Bố sung", "Bổ sung"), ("tính,", "tỉnh,"), ("tính.", "tỉnh."), ("họp đồng", "hợp đồng"), ("Họp đồng", "Hợp đồng"),
    ("trưởng họp", "trường hợp"), ("Trưởng họp", "Trường hợp"), ("trực thuộc trung ượng", "trực thuộc trung ương"),
)
ACCENTED = {
    "a": "àáảãạăắằẳẵặâấầẩẫậ",
    "e": "èéẻẽẹêếềểễệ",
    "i": "ìíỉĩị",
    "o": "òóỏõọôốồổỗộơớờởỡợ",
    "u": "ùúủũụưứừửữự",
    "y": "ỳýỷỹỵ",
    "d": "đ",
}
STOPWORDS = "la cua va cac mot nhung duoc trong co cho voi tai theo ve khi de thi ma nay do nhu se da dang tu den boi vao tren duoi hoac hay rat nhat hon viec nao gi bi ra len xuong".split()
PROHIBIT = r"\b(cam|nghiem\s+cam|khong\s+duoc(\s+phep)?|khong\s+cho\s+phep|chang\s+duoc)\b"
ALLOW = r"\b(duoc\s+phep|cho\s+phep)\b"
MEASURE = r"(?iu)(\d+(?:[.,]\d+)?)\s*(m²|m³|m2|m3|mm|cm|km|mét|met|mpa|kpa|kg|°c|℃|%|m)(?![\p{L}\p{N}_])"


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, "[" + EMOJI + "]", "")


def fix_typos(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), TYPOS, c)


def strip_date_noise(c: Column) -> Column:
    x = F.regexp_replace(c, r"\n\s*\d{2}\s+\d{2}\s+\d{2}\s+\d{4}\s+\d{4}\s*$", "")
    x = F.regexp_replace(x, r"\n\s*\d{2}\s+\d{2}\s+\d{2}\s*$", "")
    return F.regexp_replace(F.regexp_replace(x, r"(?m)^\s*\d{1,3}\s*$", ""), r"^\s+|\s+$", "")


def strip_dots(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?:\.\s*){20,}", ""), r"(?:\.\s){10,}", "")


def strip_signature(c: Column) -> Column:
    """The span of a digital signature goes; a text never becomes empty."""
    x = F.regexp_replace(c, r"(?isu)(?:Ký bởi|Người ký)\s*:.+?\d{2}\.\d{2}\.\d{4}\s+\d{2}:\d{2}:\d{2}\s*[+\-]\d{2}:\d{2}", "")
    x = F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))
    return F.coalesce(F.nullif(x, F.lit("")), c)


def squash(c: Column) -> Column:
    """White space runs (also no-break spaces) as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s ]+", " "))


def fold(c: Column) -> Column:
    """Lower case without the marks of the alphabet's letters."""
    source = "".join(ACCENTED.values())
    target = "".join(k * len(v) for k, v in ACCENTED.items())
    return F.translate(F.lower(c), source, target)


def integer_token(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^0+(?=.)", "")


def polarity(c: Column) -> Column:
    """-1 for a prohibition, 1 for a permission, else 0."""
    folded = fold(c)
    return F.when(folded.rlike(PROHIBIT), -1).when(folded.rlike(ALLOW), 1).otherwise(0)


def content_tokens(c: Column) -> Column:
    words = F.split(F.regexp_replace(fold(squash(c)), "[^a-z0-9%]+", " "), " ")
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 1)), F.array(*[F.lit(w) for w in STOPWORDS]))


def token_recall(hypothesis: Column, premise: Column) -> Column:
    """Share of the hypothesis' tokens in the premise; 0 without any."""
    return F.when(F.size(hypothesis) == 0, 0.0).otherwise(F.size(F.array_intersect(hypothesis, premise)) / F.greatest(F.size(hypothesis), F.lit(1)))


def measures(c: Column) -> Column:
    """Distinct ``unit=number`` strings: aliases merged, decimal commas as points."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MEASURE), F.lit(0))

    def one(x: Column) -> Column:
        n = F.replace(F.regexp_extract(x, r"^\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit("."))
        n = F.regexp_replace(F.regexp_replace(n, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        u = F.lower(F.regexp_replace(x, r"^\d+(?:[.,]\d+)?\s*", ""))
        u = F.when(u.isin("met", "mét"), "m").when(u == "m²", "m2").when(u == "m³", "m3").when(u.isin("°c", "℃"), "c").otherwise(u)
        return F.concat(u, F.lit("="), F.regexp_replace(n, r"^0+(?=\d)", ""))

    return F.array_distinct(F.transform(raw, one))


def measure_relation(premise: Column, hypothesis: Column) -> Column:
    """conflict: a unit of both with no number in common; unsupported: a unit the
    premise lacks; else ok."""
    p, h = measures(premise), measures(hypothesis)
    unit = lambda x: F.substring_index(x, "=", 1)
    units = F.array_distinct(F.transform(h, unit))
    known = F.transform(p, unit)
    clash = F.exists(units, lambda u: F.array_contains(known, u) & ~F.exists(h, lambda x: (unit(x) == u) & F.array_contains(p, x)))
    return F.when(clash, "conflict").when(F.exists(units, lambda u: ~F.array_contains(known, u)), "unsupported").otherwise("ok")


def front_matter_stripped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^﻿", ""), r"(?s)\A---\s*\n.*?\n---\s*\n?", "")


def cache_key(query: Column, *params: Column) -> Column:
    """Hash of the normalised query and its parameters."""
    return F.concat(F.lit("t0:"), F.sha2(F.to_json(F.array(F.lower(squash(query)), *[p.cast("string") for p in params])).cast("binary"), 256))


def document_id(namespace: Column, number: Column, file_name: Column, override: Column) -> Column:
    """namespace/number, or with the file's name where the number is no plain one."""
    stem = F.replace(F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", ""), F.lit(" "), F.lit("_"))
    has = F.length(F.coalesce(number, F.lit(""))) > 0
    plain = number.rlike(r"^\d+/") | number.rlike(r"(?i)^(?:QCVN|TCVN|TCXD|TCXDVN|APPENDIX|PL)")
    raw = F.when(has & plain, F.concat_ws("/", namespace, number)).when(has, F.concat(namespace, F.lit("/"), number, F.lit("_"), stem)).otherwise(F.concat_ws("/", namespace, stem))
    return F.coalesce(F.nullif(override, F.lit("")), F.regexp_replace(raw, r"[^\p{L}\p{M}\p{N}_\-/.]", "_"))


def canonical_id(c: Column) -> Column:
    """Four families of identifiers, then a sanitised fallback."""
    x = F.trim(c)
    q, t, d, w = r"(?i)QCVN[-_\s]*(\d+)[:\-_/](\d{4})[-_\s/]*([A-Z]+)", r"(?i)TCVN[-_\s]*(?:ISO[-_\s]*)?(\d+)(?:[-_\s]+(\d+))?[:\-_/](\d{4})", r"(?i)(TCXDVN|TCXD)[-_\s]*(\d+)[:\-_/](\d{2,4})", r"(\d+)[/_\-](\d{4})[/_\-]([A-Za-z0-9Đđ_\-]+)"
    e = lambda p, k: F.regexp_extract(x, p, k)
    number = F.when(F.length(e(q, 1)) < 2, F.lpad(e(q, 1), 2, "0")).otherwise(e(q, 1))
    iso = F.contains(F.upper(x), F.lit("ISO"))
    second = F.when(F.length(e(t, 2)) > 0, F.concat(F.lit("-"), e(t, 2))).otherwise("")
    suffix = F.replace(F.upper(e(w, 3)), F.lit("_"), F.lit("-"))
    suffix = F.when(F.contains(suffix, F.lit("ND")) & ~F.contains(suffix, F.lit("NĐ")), F.replace(suffix, F.lit("ND"), F.lit("NĐ"))).otherwise(suffix)
    safe = F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}_\-/.]", "_")
    return (
        F.when(x == "", "")
        .when(x.startswith("VBPL/"), safe)
        .when(x.rlike(q), F.concat(F.lit("VBPL/QCVN_"), number, F.lit("_"), e(q, 2), F.lit("/"), F.upper(e(q, 3))))
        .when(x.rlike(t) & iso, F.concat(F.lit("VBPL/TCVN_ISO_"), e(t, 1), second, F.lit("_"), e(t, 3)))
        .when(x.rlike(t), F.concat(F.lit("VBPL/TCVN_"), e(t, 1), F.lit("_"), e(t, 3)))
        .when(x.rlike(d), F.concat(F.lit("VBPL/"), F.upper(e(d, 1)), F.lit("_"), e(d, 2), F.lit("_"), e(d, 3)))
        .when(x.rlike(w), F.concat(F.lit("VBPL/"), e(w, 1), F.lit("/"), e(w, 2), F.lit("/"), suffix))
        .otherwise(F.concat(F.lit("VBPL/"), safe))
    )


def file_metadata(name: Column) -> Column:
    """date, type, authority and number from a file's name."""
    p = r"([A-Z]{2,4})(\d+)[-/]([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)"
    day = F.regexp_extract(name, r"^(\d{8})[_\-]", 1)
    date = F.when(day != "", F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))).otherwise("unknown")
    kind, number, rest = (F.regexp_extract(name, p, k) for k in (1, 2, 3))
    parts = F.split(rest, "-")
    years = F.filter(parts, lambda x: x.rlike(r"^\d{4}$"))
    others = F.filter(parts, lambda x: ~x.rlike(r"^\d{4}$"))
    authority = F.coalesce(F.try_element_at(others, F.lit(-1)), F.lit("unknown"))
    year = F.coalesce(F.try_element_at(years, F.lit(1)), F.when(day != "", F.substring(day, 1, 4)).otherwise(""))
    doc = F.when(year != "", F.concat(number, F.lit("/"), year, F.lit("/"), kind, F.lit("-"), authority)).otherwise(F.concat(number, F.lit("/"), kind, F.lit("-"), authority))
    found = kind != ""
    return F.struct(date.alias("date"), F.when(found, kind).otherwise("unknown").alias("type"), F.when(found, authority).otherwise("unknown").alias("authority"), F.when(found, doc).otherwise("").alias("doc_number"))


def dedup_paragraphs(c: Column) -> Column:
    """Equal paragraphs of a text once, in order; short texts stay."""
    parts = F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.length(c) < 200, c).otherwise(F.array_join(F.array_distinct(parts), "\n\n"))


def page_of(c: Column, page: int, size: int) -> Column:
    return F.substring(c, (page - 1) * size + 1, size)


def coerced_hop(raw: Column) -> Column:
    """Digit strings and integral numbers as integers; the rest is null."""
    n = F.expr("NULL").cast("double")
    n = raw.try_cast("double")
    return F.when(raw.rlike(r"^\s*\d+(\.0+)?\s*$"), n.cast("int"))
