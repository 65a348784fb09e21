"""Hybrid retrieval: dense and lexical scoring, fusion, boosts, quotas and dedup."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rank constant of reciprocal-rank fusion.
RRF_K = 60
#: Chunk types that a plain search leaves out (fixed values).
SECONDARY_TYPES = ("amendment", "diff_matrix", "superseded", "instrument")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays, in double."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; a vector of length 0 is divided by 1."""
    one = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def l2_normalise(df: DataFrame, vector: str) -> DataFrame:
    """Vectors of length 1; zero vectors stay."""
    n = norm(vector)
    return df.withColumn("size", F.when(n == 0, F.lit(1.0)).otherwise(n)).withColumn(vector, F.transform(vector, lambda x: x.cast("double") / F.col("size"))).drop("size")


def term_frequencies(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): words of lower-cased letters and digits."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return rows.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def first_of_each(df: DataFrame, k: int, query: str, score: str, key: str) -> DataFrame:
    """The k best of each query with their rank; ties go by key."""
    order = W.partitionBy(query).orderBy(F.desc(score), F.asc(key))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: list[DataFrame], query: str, key: str, k: int = RRF_K) -> DataFrame:
    """Fused scores of ranked lists (query, key, rank)."""
    union = lists[0].select(query, key, "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select(query, key, "rank"))
    return union.groupBy(query, key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("fused"))


def boosted(df: DataFrame) -> DataFrame:
    """0.8 rerank + 0.2 vector, + 0.2 for tables, + 0.15 ACTIVE or - 0.3 OUTDATED."""
    s = 0.8 * F.col("rerank") + 0.2 * F.col("score")
    s = s + F.when(F.col("is_table"), 0.2).otherwise(0.0)
    return df.withColumn("final", s + F.when(F.col("status") == "ACTIVE", 0.15).when(F.col("status") == "OUTDATED", -0.3).otherwise(0.0))


def search_filter(df: DataFrame, doc_type: str | None = None, authority: str | None = None, year: int | None = None, doc_number: str | None = None, compare: bool = False) -> DataFrame:
    """Conditions on hits; secondary chunk types are left out unless versions are compared."""
    for c, v in (("doc_type", doc_type), ("authority", authority), ("doc_number", doc_number)):
        if v is not None:
            df = df.filter(F.col(c) == F.lit(v))
    if year is not None:
        df = df.filter(F.col("doc_date").startswith(str(year)))
    return df if compare else df.filter(~F.col("chunk_type").isin(*SECONDARY_TYPES))


def first_by_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key, by order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def hit_key(chunk_id: str = "chunk_id", text: str = "text") -> Column:
    """chunk_id, or the hash of the text where there is none."""
    return F.coalesce(F.nullif(F.col(chunk_id), F.lit("")), F.sha2(F.col(text).cast("binary"), 256))


def hop_quota(df: DataFrame, most: int, hop2: int) -> DataFrame:
    """If both hops occur: up to ``hop2`` of hop 2, the rest of hop 1; order kept."""
    r = df.withColumn("_n", F.row_number().over(W.partitionBy("hop").orderBy("ord")))
    counts = df.agg(F.count_if(F.col("hop") == 2).alias("n2"), F.count_if(F.col("hop") != 2).alias("n1"))
    r = r.join(F.broadcast(counts))
    quota = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.least(F.lit(hop2), F.col("n2"))).otherwise(F.least(F.lit(most), F.col("n2")))
    keep = F.when(F.col("hop") == 2, F.col("_n") <= quota).otherwise(F.col("_n") <= F.lit(most) - quota)
    return r.filter(keep).drop("_n", "n1", "n2")


def expand_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with their parent's text; without one they stay. (parent_id, text)"""
    p = parents.select(F.col("parent_id"), F.col("text").alias("parent_text"))
    out = children.join(p, "parent_id", "left")
    return out.withColumn("child_text", F.when(F.col("parent_text").isNotNull(), F.col("text"))).withColumn("text", F.coalesce("parent_text", "text")).drop("parent_text")


def with_status(rows: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Status by key, ACTIVE by default; outdated texts carry a warning."""
    out = rows.join(status, key, "left").withColumn("status", F.coalesce("status", F.lit("ACTIVE")))
    return out.withColumn("text", F.when(F.col("status") == "OUTDATED", F.concat(F.lit("[OUTDATED] "), F.col("text"))).otherwise(F.col("text")))


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of unit rows; zero rows stay."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    m = flat.reshape(len(column), -1).astype(np.float64)
    n = np.sqrt((m**2).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


#: Queries that meet a cell's vectors together: their similarities are the largest matrix.
_TOGETHER = 256


def nearest(queries: DataFrame, rows: DataFrame, k: int, least: float = -2.0) -> DataFrame:
    """(q_id, c_id, sim, rank): for each query (q_id, filter_key, q_vec) the k rows (c_id,
    filter_key, c_vec) of the largest cosine under the same filter_key, from ``least`` on; exact.
    A row of the query's own id is left out. Cosines are rounded to nine digits, ties go by c_id;
    a null filter_key meets no other; zero vectors match nothing."""
    # Queries and rows of a key are dealt to a grid of cells of bounded size, each cell is
    # some products of matrices, and a query keeps the best of its cells.
    def side(df: DataFrame, i: str, v: str, most: int, cells: str) -> tuple[DataFrame, DataFrame]:
        n = df.groupBy("filter_key").agg(F.ceil(F.count("*") / most).cast("int").alias(cells))
        return df.select(F.col("filter_key").alias("filter_key"), F.col(i).cast("long").alias("id"), F.col(v).alias("v")), n

    (q, nq), (c, nc) = side(queries, "q_id", "q_vec", 4096, "nq"), side(rows, "c_id", "c_vec", 16384, "nc")
    grid = nq.join(nc, "filter_key")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    q = q.join(grid, "filter_key").select("filter_key", place("nq").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("j"), "id", "v")
    c = c.join(grid, "filter_key").select("filter_key", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("i"), place("nc").alias("j"), "id", "v")

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(a) and len(b):
            b = b.sort_by("id")
            ids, own, y = b["id"].to_numpy(), a["id"].to_numpy(), _rows(b["v"])
            x = _rows(a["v"])
            for at in range(0, len(own), _TOGETHER):
                mine = own[at : at + _TOGETHER]
                sims = np.round(x[at : at + _TOGETHER] @ y.T, 9)
                sims[mine[:, None] == ids[None, :]] = -np.inf
                bar = np.maximum(least, np.partition(sims, -k, axis=1)[:, -k]) if sims.shape[1] > k else np.full(len(mine), least)
                i, j = np.nonzero((sims >= bar[:, None]) & np.isfinite(sims))
                order = np.lexsort((j, -sims[i, j], i))  # of equal ones the least id first
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                found.append((mine[i[keep]], ids[j[keep]], sims[i[keep], j[keep]]))
        return pa.table([np.concatenate(p) for p in zip(*found, strict=True)], names=["q_id", "c_id", "sim"])

    met = q.filter("v IS NOT NULL").groupBy("filter_key", "i", "j").cogroup(c.filter("v IS NOT NULL").groupBy("filter_key", "i", "j")).applyInArrow(cell, "q_id long, c_id long, sim double")
    order = W.partitionBy("q_id").orderBy(F.desc("sim"), "c_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_match(queries: DataFrame, cache: DataFrame, least: float) -> DataFrame:
    """For each query vector the best other cached vector under the same filter_key, if
    its cosine is ``least`` or more. Queries: (q_id, filter_key, q_vec); cache: (c_id, filter_key, c_vec)."""
    return nearest(queries, cache, 1, least).drop("rank")


def decayed_top(turns: DataFrame, decay: float = 0.8, keep: int = 20) -> DataFrame:
    """Per session, items by their latest score times decay for each later turn."""
    last = turns.groupBy("session").agg(F.max("turn").alias("last_turn"))
    latest = turns.groupBy("session", "item").agg(F.max_by("score", "turn").alias("score"), F.max("turn").alias("turn"))
    scored = latest.join(last, "session").withColumn("decayed", F.col("score") * F.pow(F.lit(decay), F.col("last_turn") - F.col("turn")))
    w = W.partitionBy("session").orderBy(F.desc("decayed"), "item")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).select("session", "item", "decayed", "rank")
