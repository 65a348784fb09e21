"""Hooks: functions of the caller's that score, rerank, rewrite, plan, judge or embed.

Each runs over Arrow batches inside Spark tasks. What a failing hook gives instead is part
of the operator, so one bad batch or row never stops a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a document that a reranker reads.
RERANK_CHARS = 1500
SUB_QUERIES = 3


def scored(df: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.DataFrame], a: str, b: str, out: str = "probs") -> DataFrame:
    """Three probabilities for each row; null where the scorer fails or gives none."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        try:
            p = scorer(x, y).to_numpy(float)
        except Exception:
            return pd.Series([None] * len(x))
        good = np.isfinite(p).all(axis=1) & (p >= 0).all(axis=1) & (np.abs(p.sum(axis=1) - 1) < 1e-3)
        return pd.Series([list(r) if g else None for r, g in zip(p, good, strict=True)])

    return df.withColumn(out, F.pandas_udf(run, "array<double>")(F.col(a), F.col(b)))


def reranked(df: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], query: str, text: str, out: str = "rerank") -> DataFrame:
    """A score of query and document's first characters; zeros where the scorer fails."""

    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        try:
            return score(q, t.str.slice(0, RERANK_CHARS)).astype(float)
        except Exception:
            return pd.Series(np.zeros(len(q)))

    return df.withColumn(out, F.pandas_udf(run, "double")(F.col(query), F.col(text)))


def sampled(df: DataFrame, sampler: Callable[[pd.DataFrame], None]) -> DataFrame:
    """The same rows; the sampler sees every batch, and its errors change nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                sampler(b.copy())
            except Exception:
                pass
            yield b

    return df.mapInPandas(run, df.schema)


def rewritten(df: DataFrame, rewrite: Callable[[str], str | None], query: str, out: str = "rewritten") -> DataFrame:
    """A query's other form; the query itself where the hook fails or gives nothing. Equal
    queries are rewritten once for each batch."""

    def run(q: pd.Series) -> pd.Series:
        seen: dict = {}
        for x in q.unique():
            try:
                seen[x] = rewrite(x) or x
            except Exception:
                seen[x] = x
        return q.map(seen)

    return df.withColumn(out, F.pandas_udf(run, "string")(F.col(query)))


def planned(df: DataFrame, plan: Callable[[str], list[str]], query: str) -> DataFrame:
    """A row for each of at most three sub-queries; the query itself where the hook fails
    or gives none."""

    def run(q: pd.Series) -> pd.Series:
        out = []
        for x in q:
            try:
                out.append(list(plan(x))[:SUB_QUERIES] or [x])
            except Exception:
                out.append([x])
        return pd.Series(out)

    return df.select("*", F.posexplode(F.pandas_udf(run, "array<string>")(F.col(query))).alias("n", "sub_query"))


def custom_chunks(docs: DataFrame, chunker: Callable[[str], list[str]], key: str, text: str) -> DataFrame:
    """A caller's own chunking strategy: key, n, chunk."""
    run = F.pandas_udf(lambda s: s.map(lambda x: list(chunker(x)) if x is not None else []), "array<string>")
    return docs.select(key, F.posexplode(run(F.col(text))).alias("n", "chunk"))


def judged(df: DataFrame, judge: Callable[[str, str], tuple[float, float, float]], question: str, answer: str) -> DataFrame:
    """faithfulness, relevance and score of each answer; 0.5, 0.5 and 50 where the judge fails."""

    def run(q: pd.Series, a: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(q, a, strict=True):
            try:
                rows.append(tuple(map(float, judge(x, y))))
            except Exception:
                rows.append((0.5, 0.5, 50.0))
        return pd.DataFrame(rows, columns=["faithfulness", "relevance", "score"])

    j = F.pandas_udf(run, "faithfulness double, relevance double, score double")(F.col(question), F.col(answer))
    return df.withColumn("j", j).select(*df.columns, "j.*")


def embedded(df: DataFrame, embed: Callable[[pd.Series], list], text: str, prefix: str = "") -> DataFrame:
    """A dense vector, lexical weights (counts of words) and the words used of each text."""
    dense = F.pandas_udf(lambda s: pd.Series(list(embed(prefix + s.fillna("")))), "array<float>")
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    lexical = F.aggregate(F.array_distinct("words"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")), lambda m, w: F.map_concat(m, F.create_map(w, F.size(F.filter("words", lambda x: x == w)))))
    return df.withColumn("words", words).withColumns({"dense": dense(F.col(text)), "usage": F.size("words"), "sparse": lexical}).drop("words")


def hashed_vectors(texts: pd.Series, width: int = 16) -> list:
    """A stand-in for an embedding model: letters counted by code, length one."""
    out = []
    for t in texts:
        v = np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) % width, minlength=width).astype(float) if t else np.zeros(width)
        out.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32))
    return out


def hop2(first: DataFrame, second: DataFrame, query: str, text: str, sufficient: Column) -> DataFrame:
    """Rows of hop 1, and for queries that they don't suffice for the rows of hop 2 whose
    first 200 characters hop 1 has not. sufficient: an aggregate over a query's rows."""
    poor = first.groupBy(query).agg(sufficient.alias("enough")).filter("NOT enough").select(query)
    head = F.substring(text, 1, 200)
    new = second.join(poor, query, "left_semi").withColumn("head", head).filter("head <> ''")
    new = new.join(first.select(query, head.alias("head")).distinct(), [query, "head"], "left_anti").dropDuplicates([query, "head"])
    return first.withColumn("hop", F.lit(1)).unionByName(new.drop("head").withColumn("hop", F.lit(2)))
