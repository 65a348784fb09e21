"""Sinks: index rows, document exports, archives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

TEXT_CHARS, SUMMARY_CHARS = 14000, 2048


def index_rows(chunks: DataFrame, width: int) -> DataFrame:
    """Rows as they are stored: defaults, cut texts, vectors of the right width (else
    zeros), sparse weights without negative keys."""
    text = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d)).alias(c)
    vector = F.when(F.size("vector") == width, F.col("vector")).otherwise(F.array_repeat(F.lit(0.0).cast("float"), width))
    return chunks.select(
        text("doc_id", "unknown"),
        F.substring(F.coalesce("text", F.lit("")), 1, TEXT_CHARS).alias("text"),
        F.substring(F.coalesce("summary", F.lit("")), 1, SUMMARY_CHARS).alias("summary"),
        F.coalesce(F.col("page").cast("int"), F.lit(0)).alias("page"),
        F.coalesce(F.col("is_table"), F.lit(False)).alias("is_table"),
        vector.alias("vector"),
        F.map_filter("sparse", lambda k, v: k >= 0).alias("sparse"),
    )


def enriched_chunks(chunks: DataFrame, docs: DataFrame, fields: list[str]) -> DataFrame:
    """Chunks whose empty or unknown fields take their document's values."""
    d = docs.select("doc_id", *[F.col(f).alias(f"_{f}") for f in fields])
    out = chunks.join(d, "doc_id", "left")
    known = lambda c: F.when(F.length(F.trim(c)) > 0, F.when(~F.lower(c).isin("unknown", "none", "n/a"), F.col(c)))
    return out.withColumns({f: F.coalesce(known(f), F.col(f"_{f}"), F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])


def nested_export(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each document, its chunks as a sorted array of structs."""
    rest = [c for c in chunks.columns if c not in keys and c not in order]
    return chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("chunks"))


def markdown_export(chunks: DataFrame) -> DataFrame:
    """doc_id, page, n, heading, text of parents as one Markdown text a document; equal
    texts once."""
    first = chunks.groupBy("doc_id", F.trim("text").alias("text")).agg(F.min(F.struct("page", "n", "heading")).alias("at"))
    rows = F.array_sort(F.collect_list(F.struct("at.page", "at.n", "at.heading", "text")))
    part = lambda x: F.when(F.coalesce(x["heading"], F.lit("")) == "", x["text"]).otherwise(F.concat(F.lit("## "), x["heading"], F.lit("\n\n"), x["text"]))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(rows, part), "\n\n").alias("markdown"))


def write_archive(rows: DataFrame, path: str) -> None:
    """Compressed JSON lines."""
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def write_observed(rows: DataFrame, write: Callable[[DataFrame], None], **metrics: Column) -> dict:
    """Writes rows and returns metrics of them, taken in the same pass."""
    seen = Observation()
    write(rows.observe(seen, *[m.alias(n) for n, m in metrics.items()]))
    return seen.get
