"""Approximate vector search: cells of a coarse quantiser, product codes of what is left, and
exact scoring of the candidates.

An index is fitted on a bounded sample (``SAMPLE`` vectors, those with the least hash) and holds
every row: ``codes`` (cell, ids, codes), packed rows of a cell in blocks of bounded size, in
folders by cell; ``vectors`` (id, v), unit vectors in folders by the id's hash; ``model``, the
centres. A search probes each query's nearest cells, adds up table entries instead of
multiplying vectors, keeps ``depth`` candidates of each query and scores these exactly, so that
similarities are exact and only membership is approximate.

Queries are packed by cell, so a cell's blocks meet its queries in one join; a large cell
has many blocks, each with its own row of that join.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.operators.retrieval import cosine

#: Vectors of the sample; cells; parts of a vector with a code of a byte each; codes of a part.
SAMPLE = 16_384
CELLS = 32
PARTS = 16
CODES = 64
#: Rows of a packed block, and folders of the vectors.
BLOCK = 4096
FOLDERS = 16


@dataclass(frozen=True)
class Model:
    centres: np.ndarray  # cells x width
    books: np.ndarray  # parts x codes x (width / parts)

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def split(self, rows: np.ndarray) -> np.ndarray:
        """Rows filled up with 0 to a whole number of parts: parts x rows x width of a part."""
        parts, _, wide = self.books.shape
        full = np.zeros((len(rows), parts * wide))
        full[:, : rows.shape[1]] = rows
        return full.reshape(len(rows), parts, wide).transpose(1, 0, 2)

    def cell(self, rows: np.ndarray) -> np.ndarray:
        return _nearest(rows, self.centres)

    def encode(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """A byte for each part of what the cell's centre leaves."""
        left = self.split(rows - self.centres[cells])
        return np.stack([_nearest(x, book) for x, book in zip(left, self.books, strict=True)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codes: queries x parts x codes."""
        return np.einsum("pqw,pcw->qpc", self.split(queries), self.books)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def _centres(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k-means; always alike for the same rows."""
    rng = np.random.default_rng(seed)
    found = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(rows, found)
        for c in range(len(found)):
            mine = rows[near == c]
            if len(mine):
                found[c] = mine.mean(axis=0)
    return found


def fit(sample: np.ndarray, cells: int = CELLS, parts: int = PARTS, codes: int = CODES) -> Model:
    centres = _centres(sample, cells)
    wide = -(-sample.shape[1] // parts)
    model = Model(centres, np.zeros((parts, 1, wide)))
    left = model.split(sample - centres[model.cell(sample)])
    books = [_centres(x, codes, seed=p) for p, x in enumerate(left)]
    return Model(centres, np.stack(books))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


_SCHEMAS = {"vectors": "id long, v array<double>, folder int", "codes": "block long, ids array<long>, codes array<binary>, cell int"}


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    model: Model

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}")


def _unit(vector: str = "v") -> object:
    square = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return F.transform(vector, lambda x: F.try_divide(x.cast("double"), F.sqrt(square)))


def build(rows: DataFrame, path: str, cells: int = CELLS, parts: int = PARTS) -> None:
    """Writes the index of ``rows`` (id, v) to ``path``. Rows without a vector, or with one of
    length 0, are in no answer; all vectors have the same width."""
    unit = rows.filter("v IS NOT NULL").select(F.col("id").cast("long").alias("id"), _unit().alias("v")).filter("size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x))")
    unit.withColumn("folder", F.pmod(F.xxhash64("id"), F.lit(FOLDERS)).cast("int")).repartition("folder").sortWithinPartitions("folder", "id").write.partitionBy("folder").parquet(f"{path}/vectors")
    spark = rows.sparkSession
    held = spark.read.schema(_SCHEMAS["vectors"]).parquet(f"{path}/vectors").select("id", "v")
    sample = held.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()["v"].combine_chunks()
    model = fit(_matrix(sample), cells, parts) if len(sample) else Model(np.zeros((1, 1)), np.zeros((1, 1, 1)))
    spark.createDataFrame([(pickle.dumps((model.centres, model.books)),)], "body binary").coalesce(1).write.parquet(f"{path}/model")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                at = model.cell(m)
                codes = model.encode(m, at)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "cell", "code"])

    coded = held.mapInArrow(encode, "id long, cell int, code binary")
    dealt = coded.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "id").sortWithinPartitions("cell", "id")
    blocks = dealt.withColumn("block", F.expr(f"monotonically_increasing_id() div {BLOCK}")).groupBy("cell", "block")
    packed = blocks.agg(F.array_sort(F.collect_list(F.struct("id", "code"))).alias("x")).select("cell", "block", F.col("x.id").alias("ids"), F.col("x.code").alias("codes"))
    packed.repartition("cell").write.partitionBy("cell").parquet(f"{path}/codes")


def load(spark: SparkSession, path: str) -> VectorIndex:
    body = spark.read.parquet(f"{path}/model").first()[0]
    return VectorIndex(spark, path, Model(*pickle.loads(body)))


def candidates(index: VectorIndex, queries: DataFrame, depth: int, probes: int) -> DataFrame:
    """(q_id, id): of each query (q_id, v) the ``depth`` rows of its ``probes`` nearest cells
    that the codes rate best, the query's own id left out."""
    model = index.model
    probes = min(probes, len(model.centres))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                far = (model.centres**2).sum(axis=1) - 2 * m @ model.centres.T
                near = np.argsort(far, axis=1, kind="stable")[:, :probes]
                n = np.repeat(np.arange(len(m)), probes)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(n)), b.column(1).take(pa.array(n)), pa.array(near.reshape(-1).astype(np.int32))], ["q_id", "v", "cell"])

    unit = queries.filter("v IS NOT NULL").select(F.col("q_id").cast("long").alias("q_id"), _unit().alias("v")).filter("size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x))")
    asked = unit.mapInArrow(probe, "q_id long, v array<double>, cell int")
    packs = asked.withColumn("pack", F.pmod(F.xxhash64("q_id"), F.lit(16))).groupBy("cell", "pack").agg(F.collect_list(F.struct("q_id", "v")).alias("x")).select("cell", F.col("x.q_id").alias("q_ids"), F.flatten("x.v").alias("vs"))
    met = packs.join(index.table("codes").select("cell", "ids", "codes"), "cell")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                cell = b.column(0)[r].as_py()
                q_ids, q = np.array(b.column(1)[r].as_py()), np.array(b.column(2)[r].as_py()).reshape(-1, model.width)
                ids = np.array(b.column(3)[r].as_py())
                codes = np.frombuffer(b"".join(b.column(4)[r].as_py()), np.uint8).reshape(len(ids), -1)
                tables = model.tables(q)
                sims = np.repeat((q @ model.centres[cell])[:, None], len(ids), axis=1)
                for p in range(codes.shape[1]):
                    sims += tables[:, p, codes[:, p]]
                sims[q_ids[:, None] == ids[None, :]] = -np.inf
                best = np.argsort(-sims, axis=1, kind="stable")[:, :depth]
                i = np.repeat(np.arange(len(q)), best.shape[1])
                j = best.reshape(-1)
                keep = np.isfinite(sims[i, j])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i[keep]]), pa.array(ids[j[keep]]), pa.array(sims[i[keep], j[keep]])], ["q_id", "id", "about"])

    rated = met.select("cell", "q_ids", "vs", "ids", "codes").mapInArrow(rate, "q_id long, id long, about double")
    order = W.partitionBy("q_id").orderBy(F.desc("about"), "id")
    return rated.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= depth).select("q_id", "id")


def search(index: VectorIndex, queries: DataFrame, k: int, depth: int | None = None, probes: int = 28) -> DataFrame:
    """(q_id, id, sim, rank): about the k rows of the largest cosine with each query (q_id, v);
    cosines are exact, rounded to nine digits."""
    found = candidates(index, queries, depth or 20 * k, probes)
    vectors = index.table("vectors").select("folder", "id", F.col("v").alias("row"))
    met = found.withColumn("folder", F.pmod(F.xxhash64("id"), F.lit(FOLDERS)).cast("int")).join(vectors, ["folder", "id"]).join(queries.select("q_id", "v"), "q_id")
    scored = met.select("q_id", "id", F.round(cosine("v", "row"), 9).alias("sim"))
    order = W.partitionBy("q_id").orderBy(F.desc("sim"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
