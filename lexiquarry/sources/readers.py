"""Readers: Markdown, JSON exports, QA lists, registries and spreadsheets of text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions.text import front_matter_stripped

CHUNK = "text string, page int, chunk_type string, parent_id string, hierarchy_path string, is_table boolean"
EXPORT = f"doc_id string, original_path string, summary string, metadata map<string,string>, chunks array<struct<{CHUNK}>>"
QA = "question string, expected_doc_numbers array<string>, expected_answer_span string, category string, min_recall_at_k double"
FORMATS = {"pdf": "pdf", "docx": "word", "doc": "word", "xlsx": "sheet", "xls": "sheet", "png": "image", "jpg": "image", "jpeg": "image", "md": "markdown"}


def routed(files: DataFrame) -> DataFrame:
    """Files (path) with the reader of their extension; unknown ones get an error."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    route = F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), ext)
    return files.withColumns({"route": F.coalesce(route, F.lit("failed")), "error": F.when(route.isNull(), F.concat(F.lit("unsupported format: "), ext))})


def markdown_pages(spark: SparkSession, path: str) -> DataFrame:
    """One page for each Markdown file, without byte-order mark and front matter."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.lit(1).alias("page"), front_matter_stripped(F.col("value")).alias("text"))


def export_chunks(spark: SparkSession, path: str, most: int = 14000) -> DataFrame:
    """Chunks of JSON exports with their document's metadata; texts cut to ``most``."""
    docs = spark.read.schema(EXPORT).option("multiLine", "true").json(path)
    rows = docs.select("doc_id", "summary", F.col("metadata")["doc_type"].alias("doc_type"), F.posexplode("chunks").alias("n", "c"))
    return rows.select("doc_id", "doc_type", "n", F.substring("c.text", 1, most).alias("text"), "c.page", "c.chunk_type", "c.parent_id")


def qa_list(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines file; unknown keys and malformed lines are dropped."""
    return spark.read.schema(QA).option("mode", "DROPMALFORMED").json(path)


def merged_catalog(registry: DataFrame, bundles: DataFrame) -> DataFrame:
    """Registry rows with their bundle's metadata, found by path, slug, id or number in
    this order; the bundle's values stand where there are any."""
    meta = F.struct(*[F.col(c) for c in bundles.columns])
    out = registry
    for k in ("path", "slug", "id", "number"):
        found = bundles.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(meta).alias(f"by_{k}"))
        out = out.join(found, k, "left")
    best = F.coalesce("by_path", "by_slug", "by_id", "by_number")
    return out.select(*[F.coalesce(best[c], F.col(c)).alias(c) if c in bundles.columns else F.col(c) for c in registry.columns]).orderBy("slug")


def extracted_pages(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages of binary files (path, content) by an injected extractor; a failure gives
    one empty page with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, i + 1, text, None) for i, text in enumerate(extract(content))]
                except Exception as e:  # the error is the row's result
                    rows.append((path, 1, "", str(e)))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def sheet_markdown(rows: DataFrame, key: str, n: str, cells: str) -> DataFrame:
    """Rows of cells (array) as one Markdown table for each key: padded, first row as header."""
    w = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(n).alias("n"), F.col(cells).alias("c")))).alias("r")).filter(F.size("r") >= 2)
    width = F.array_max(F.transform("r", lambda x: F.size(x["c"])))
    w = w.withColumn("w", width)
    line = lambda c: F.concat(F.lit("| "), F.array_join(F.concat(c, F.array_repeat(F.lit(""), F.col("w") - F.size(c))), " | "), F.lit(" |"))
    sep = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("w")), " | "), F.lit(" |"))
    body = F.transform("r", lambda x: line(x["c"]))
    return w.select(key, F.array_join(F.concat(F.slice(body, 1, 1), F.array(sep), F.slice(body, 2, 1_000_000)), "\n").alias("text"))
