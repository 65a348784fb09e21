"""The corpus pipeline: five operators after each other over ``documents``.

Each stage takes what the one before kept, written as Parquet and read again.

Defined results, for all stages: null text counts as empty and keeps being null unless the
row goes; a null doc_id is an id like others, the largest; rows of one doc_id are told apart
by their text; repeated rows (id and text) may become one from ``dedup_documents`` on; other
columns are carried along, whatever their names; texts are read whole, however long; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiquarry.llm import decontaminate, language, lines, mixing, neardup
from lexiquarry.llm.common import stored


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: a row whose text is null or has no letter goes, and so
    does one whose language scores under 0.3. Without labelled rows all go."""
    return language.keep_known_languages(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat, or nearly repeat, an earlier one. No row goes: a text
    whose lines all go is empty."""
    return lines.remove_repeated_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least doc_id. Texts
    without words are one class."""
    return neardup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. An empty benchmark leaves all."""
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each copy that the mix takes, with the copy's number. Documents
    without words are never taken."""
    return mixing.mix_documents(docs)


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontaminate", decontaminated),
    ("mix_sources", mixed),
]

#: SQL can't express the language model and the latent space.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
