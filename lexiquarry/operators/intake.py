"""Pages, exports and stores as they come in: features, routing, repairs, synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.functions.text import canonical_id

# Thresholds and words that results must equal.
AMENDMENTS = (("SD1-2023", "09/2023", "VBPL/09/2023/TT-BXD"), ("SD1-2026", "31/2026", "VBPL/31/2026/TT-BXD"), ("06/2022", "06/2022", "VBPL/06/2022/TT-BXD"), ("03/2021", "03/2021", "VBPL/03/2021/TT-BXD"))
CONTENTS_LINE = r"(?m)^[ \t]*[0-9]+\.(?:[0-9]*\.?)?\s+[A-ZĐÀÁẢÃẠ][^\n]*[0-9]{1,3}[ \t]*$"
CONTENTS_INLINE = r"[0-9]+\.\s+[A-ZĐÀÁẢÃẠ]{3,}.*?[0-9]+\s+[0-9]+\.[0-9]+"
ANNEX = r"(?i)phụ lục\s+[0-9]+|đơn vị\s*:|tổng cộng|số tt|ghi chú"
COMMON_WORDS = ("của", "và", "các", "là", "có", "được", "cho", "trong", "theo", "quy", "định")


def catalog_id(c: Column) -> Column:
    """The canonical id, with the amendments' own ids first."""
    x = F.trim(c)
    out = canonical_id(c)
    for a, b, known in reversed(AMENDMENTS):
        out = F.when(~x.startswith("VBPL/") & (F.contains(x, F.lit(a)) | F.contains(x, F.lit(b))), known).otherwise(out)
    return out


def page_difficulty(noise: Column, skew: Column, contrast: Column, density: Column) -> Column:
    """0 to 100 from a page's blur, skew, contrast and share of dark pixels."""
    score = F.when(noise < 5, 30).when(noise > 60, 20).otherwise(0)
    score = score + F.when(contrast < 30, 25).when(contrast < 50, 10).otherwise(0)
    score = score + F.when(skew > 2.0, 15).when(skew > 0.5, 5).otherwise(0)
    return F.least(F.lit(100), score + F.when(density < 0.05, 15).when(density > 0.6, 10).otherwise(0))


def is_blank_page(white: Column, text: Column, ocr_failed: Column) -> Column:
    """Over 90% white and at most 60 characters; never where the reader failed."""
    return ~ocr_failed & (F.length(F.trim(F.coalesce(text, F.lit("")))) <= 60) & (white > 0.9)


def is_contents(c: Column) -> Column:
    """A table of contents, by lines that end in a page number."""
    n = F.regexp_count(c, F.lit(CONTENTS_LINE))
    named = F.contains(F.lower(c), F.lit("mục lục")) | F.contains(F.lower(c), F.lit("nội dung"))
    return (F.length(c) >= 50) & ((named & (n >= 2)) | (n >= 4) | c.rlike(CONTENTS_INLINE))


def page_route(score: Column, has_table: Column, difficulty: Column, text: Column, blank: Column, contents: Column, failed: Column) -> Column:
    """vision, empty or ocr: by the reader's score against a threshold that a table lowers
    and difficulty raises."""
    base = F.when(has_table, 55).otherwise(70)
    annex = ~has_table & text.rlike(ANNEX)
    threshold = F.when(annex, 80).when(difficulty >= 50, F.least(F.lit(90), base + 20)).when(difficulty >= 25, base + 10).otherwise(base)
    return F.when(failed, "vision").when(blank | contents, "empty").when((score < threshold) | annex, "vision").otherwise("ocr")


def language_quality(c: Column) -> Column:
    """30 for length, 40 for the share of common words, 30 for letters with marks; 0 under
    10 characters."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    common = F.size(F.filter(words, lambda w: F.lower(w).isin(*COMMON_WORDS)))
    marks = F.regexp_count(c, F.lit("[àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđ]"))
    n = F.greatest(F.length(c), F.lit(1))
    score = F.least(F.lit(30.0), F.length(c) / 50) + 40.0 * common / F.greatest(F.size(words), F.lit(1)) + F.least(F.lit(30.0), 300.0 * marks / n)
    return F.when(F.coalesce(F.length(c), F.lit(0)) < 10, 0.0).otherwise(F.round(F.least(F.lit(100.0), score), 1))


def synced_status(updates: DataFrame, stores: dict[str, DataFrame], key: str) -> DataFrame:
    """Each update with the stores that hold its document, and whether all, some or none do."""
    out = updates
    for name, rows in stores.items():
        out = out.join(rows.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    done = sum((F.col(n).cast("int") for n in stores), F.lit(0))
    return out.withColumn("outcome", F.when(done == len(stores), "full").when(done > 0, "partial").otherwise("none"))


def reprocessed(docs: DataFrame, key: str, text: str, new: Column) -> DataFrame:
    """An export's next version: old and new content and whether it changed; what comes
    before a ``## Content`` line is kept. ``reverted`` goes back."""
    mark = F.instr(F.col(text), F.lit("## Content\n"))
    out = F.when(mark > 0, F.concat(F.substring(text, F.lit(1), mark + 10), new)).otherwise(new)
    return docs.select(key, F.col(text).alias("before"), out.alias("after")).withColumn("changed", F.coalesce(F.col("before") != F.col("after"), F.lit(False)))


def reverted(versions: DataFrame, key: str, text: str) -> DataFrame:
    return versions.select(key, F.col("before").alias(text))


def content_of(c: Column) -> Column:
    """What follows the ``## Content`` line, or all."""
    mark = F.instr(c, F.lit("## Content\n"))
    return F.when(mark > 0, F.substring(c, mark + 11, F.length(c))).otherwise(c)


def parsed_json(c: Column, schema: str) -> Column:
    """The JSON of a text, in a fence or bare, by a schema; null where it doesn't parse."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.trim(c))
    return F.when(body.startswith("{") | body.startswith("["), F.from_json(body, schema))


def bundle_rows(bundles: DataFrame, key: str, chunks: str, constants: dict[str, str]) -> DataFrame:
    """All chunks of all bundles, with constant columns."""
    rows = bundles.select(key, F.posexplode(chunks).alias("n", "chunk"))
    return rows.withColumns({k: F.lit(v) for k, v in constants.items()})


def cleared(df: DataFrame, path: str) -> None:
    """A table without its rows, its schema kept."""
    df.limit(0).write.mode("overwrite").parquet(path)
