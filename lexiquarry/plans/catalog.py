"""Registry of the queries and of the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("retrieval", "telemetry", "rules", "documents", "stores", "legal", "upkeep", "cleaning", "chunking", "streams", "intake", "bound")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_hybrid_search"](spark, sf_dir)


def _modules() -> list:
    return [importlib.import_module(f"lexiquarry.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query of the modules in this folder."""
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB, by the same names."""
    out: dict[str, str] = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out
