"""Whole tables with the domain's marks planted before every text, alike in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.session import table


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def planted(spark, d: str, variants: list[str], name: str = "documents", keys: tuple[str, ...] = ("doc_id",), after: bool = False) -> DataFrame:
    """Every row of the table, its text behind (or before) one of the variants, in turn."""
    at = F.element_at(F.array(*[F.lit(v) for v in variants]), (F.col(keys[-1]) % len(variants) + 1).cast("int"))
    parts = (F.col("text"), F.lit("\n"), at) if after else (at, F.lit("\n"), F.col("text"))
    return table(spark, d, name).select(*keys, F.concat(*parts).alias("text"))


def planted_sql(variants: list[str], name: str = "documents", keys: tuple[str, ...] = ("doc_id",), after: bool = False) -> str:
    """The same rows as a SQL subquery."""
    at = f"[{', '.join(map(quoted, variants))}][CAST({keys[-1]} % {len(variants)} + 1 AS INTEGER)]"
    text = f"text || chr(10) || {at}" if after else f"{at} || chr(10) || text"
    return f"(SELECT {', '.join(keys)}, {text} AS text FROM {name})"


def replaced_sql(expr: str, steps: list[tuple[str, str]]) -> str:
    """Nested regular replacements; Spark's ``$1`` as ``\\1``."""
    for pattern, new in steps:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(new.replace('$', chr(92)))}, 'g')"
    return expr


def strip_sql(expr: str) -> str:
    return replaced_sql(expr, [(r"^\s+|\s+$", "")])
