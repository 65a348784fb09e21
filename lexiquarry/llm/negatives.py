"""Hard-negative mining by one-dimensional distance keys.

Vectors hold integers; a row's score is its inner product with the anchor. Each vector gets
one more component, so that all have the same length; then a higher score is a smaller
distance, and an anchor (with 0 there) has its best rows nearest. The index stores all vectors
sorted by (pivot, distance to the pivot), the pivot being the nearest of a few, and cut into
blocks of one cell: a pivot and an interval of its distances. By the triangle inequality a row
at distance r of an anchor has a key within r of the anchor's own distance to the pivot.

A search takes an anchor's cells in the order of that bound: the nearest few, then four times
as many while it has fewer than k rows, then all that its k-th row doesn't rule out, which
certifies its answer. Rows must lie in a ring of distances (scores from ``lo`` to ``hi``); cells
inside of the ring are skipped as those beyond it are. Anchors near each other form groups
of up to ``GROUP``, so a block meets a matrix of anchors; a group is paired with the blocks of
the cells that some of its anchors ask for, by joins on cell, group and block. No answer is
approximate, and no step depends on how near the pivots lie; they come from a sample of
``SAMPLE`` vectors (those with the least hash).

Equal vectors of one label count as often as an answer can hold them: of each only those with
the least ids are indexed, chosen before the shuffle. Equal anchors are one search.

Defined results: a row without label or vector, or with a component that is null or not finite,
takes no part, nor does one whose components' squares sum to 2^53 or more, as its scores
would not be exact; shorter vectors are filled up with 0; an empty vector is all 0; rows equal
in vec_id, label and vector are one; other rows of an anchor's vec_id are not its positives; a
null vec_id comes after all others and is no anchor; ties go by vec_id; other columns are
ignored, whatever their names; without rows or without anchors the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.llm.common import bounded_batches, shuffle_width, stored

PIVOTS = 32
#: Intervals of a pivot's distances.
BINS = 8
#: Vectors from which pivots are chosen.
SAMPLE = 4096
#: Rows of a block, and anchors of a group, at most.
BLOCK = 2048
GROUP = 256
#: Cells of a first scan; a scan without enough rows is followed by one of this factor.
FIRST_CELLS = 4
GROWTH = 4
_EXACT = float(1 << 53)


@dataclass(frozen=True)
class Keys:
    """The geometry that all tasks share; of fixed size."""

    pivots: np.ndarray  # one more column than vectors have
    top: float  # the largest squared length of a vector
    low: np.ndarray  # for each cell its least and largest distance
    high: np.ndarray

    @property
    def slack(self) -> float:
        """More than the distances' rounding."""
        return 1e-6 * float(np.sqrt(self.top + (self.pivots**2).sum(axis=1).max(initial=0.0)))

    def distances(self, vectors: np.ndarray, last: np.ndarray) -> np.ndarray:
        """To all pivots, of vectors with these last components."""
        square = (vectors**2).sum(axis=1) + last**2
        dots = vectors @ self.pivots[:, :-1].T + last[:, None] * self.pivots[:, -1]
        return np.sqrt(np.maximum(0, square[:, None] + (self.pivots**2).sum(axis=1) - 2 * dots))

    def of_rows(self, vectors: np.ndarray) -> np.ndarray:
        return self.distances(vectors, np.sqrt(np.maximum(0, self.top - (vectors**2).sum(axis=1))))

    def of_anchors(self, vectors: np.ndarray) -> np.ndarray:
        return self.distances(vectors, np.zeros(len(vectors)))

    def radius(self, vectors: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The distance from an anchor at which rows have a score."""
        with np.errstate(invalid="ignore"):
            return np.sqrt(np.maximum(0, (vectors**2).sum(axis=1) + self.top - 2 * scores))

    def bounds(self, to_pivot: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """For anchors and cells: no row of a cell is nearer; infinite if all lie inside of the ring."""
        d = np.repeat(to_pivot, BINS, axis=1)
        near = np.maximum(np.maximum(self.low - d, d - self.high), inner[:, None])
        return np.where(self.high + d < inner[:, None] - self.slack, np.inf, near)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of doubles, filled up with 0."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _choose_pivots(sample: np.ndarray, top: float, pivots: int = PIVOTS, rounds: int = 8) -> np.ndarray:
    """Means of groups of a sample, begun from rows far from each other; always alike."""
    rows = np.hstack([sample, np.sqrt(np.maximum(0, top - (sample**2).sum(axis=1)))[:, None]])
    rows = np.unique(rows, axis=0)
    picked = [0]
    far = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(picked) < min(pivots, len(rows)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[picked[-1]]) ** 2).sum(axis=1))
    centres = rows[picked]
    for _ in range(rounds):
        near = ((rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


INDEX = "block_cell int, low double, high double, ids array<long>, labels array<long>, body binary"


def _index(rows: DataFrame, top: float, width: int) -> tuple[DataFrame, Keys]:
    """The stored index of rows (vec_id, label, v), and its keys."""
    spark = rows.sparkSession
    sample = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()["v"].combine_chunks()
    pivots = _choose_pivots(_matrix(sample, width), top)
    nothing = np.zeros(len(pivots) * BINS)
    keys = Keys(pivots, top, nothing, nothing)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = keys.of_rows(_matrix(b.column(2), width))
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "label", "v", "pivot", "distance"])

    keyed = stored(bounded_batches(rows.select("vec_id", "label", "v")).mapInArrow(key, "vec_id long, label long, v array<long>, pivot int, distance double"))
    shares = [i / BINS for i in range(1, BINS)]
    found = keyed.groupBy("pivot").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.percentile_approx("distance", shares, 10000).alias("cuts")).collect()  # a row for each pivot
    low, high = np.full((len(pivots), BINS), np.inf), np.full((len(pivots), BINS), np.inf)
    cuts = np.zeros((len(pivots), BINS - 1))
    for r in found:
        cuts[r["pivot"]] = r["cuts"]
        low[r["pivot"]], high[r["pivot"]] = [r["lo"], *r["cuts"]], [*r["cuts"], r["hi"]]
    keys = Keys(pivots, top, low.reshape(-1), high.reshape(-1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        cell = -1

        def block() -> pa.RecordBatch:
            held.sort(key=lambda r: (r[0] is None, r[0] or 0))
            ids, labels, vs, ds = zip(*held, strict=True)
            body = np.zeros((len(vs), width), np.int64)
            for i, v in enumerate(vs):
                body[i, : len(v)] = v
            kind = next(t for t in ("<i2", "<i4", "<i8") if np.abs(body).max(initial=0) <= np.iinfo(t).max)
            return pa.RecordBatch.from_pylist([{"block_cell": cell, "low": min(ds), "high": max(ds), "ids": list(ids), "labels": list(labels), "body": kind[1:].encode() + body.astype(kind).tobytes()}], schema=pa.schema([("block_cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("body", pa.binary())]))

        for b in batches:
            pivot, distance = b.column(3).to_numpy(), b.column(4).to_numpy()
            cells = pivot * BINS + (cuts[pivot] < distance[:, None]).sum(axis=1)
            for c, row in zip(cells.tolist(), zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True), strict=True):
                if held and (c != cell or len(held) >= BLOCK):
                    yield block()
                    held = []
                cell = c
                held.append(row)
        if held:
            yield block()

    order = ["pivot", "distance", F.col("vec_id").asc_nulls_last(), "v", "label"]
    dealt = keyed.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    packed = bounded_batches(dealt).mapInArrow(pack, INDEX)
    return stored(packed.withColumn("block", F.monotonically_increasing_id())), keys


def _body(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<" + raw[:2].decode(), offset=2).reshape(-1, width).astype(np.float64)


PLANNED = "sids array<string>, labels array<long>, los array<double>, his array<double>, bounds array<double>, reach array<double>, next array<int>, body binary, cells array<int>, members array<binary>"


def _plan(open_: DataFrame, keys: Keys, k: int, width: int) -> DataFrame:
    """Groups of searches (sid, label, v, lo, hi, done, bound), with the cells that each is
    to scan now. ``done`` cells are scanned; ``bound`` is the score of its k-th row."""
    spark = open_.sparkSession

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = keys.of_anchors(_matrix(b.column(2), width))
            at = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(d)), at])], ["sid", "label", "v", "lo", "hi", "done", "bound", "pivot", "distance"])

    def group(rows: list[tuple]) -> dict | None:
        sids, labels, vs, los, his, done, bounds = zip(*rows, strict=True)
        vectors = np.zeros((len(vs), width))
        for i, v in enumerate(vs):
            vectors[i, : len(v)] = v
        lo, hi = np.array([-np.inf if x is None else x for x in los]), np.array([np.inf if x is None else x for x in his])
        best = np.array([-np.inf if x is None else x for x in bounds])
        inner = np.where(np.isfinite(hi), keys.radius(vectors, np.where(np.isfinite(hi), hi, 0)), 0.0)
        least = np.maximum(lo, best)
        reach = np.where(np.isfinite(least), keys.radius(vectors, np.where(np.isfinite(least), least, 0)), np.inf) + keys.slack
        lower = keys.bounds(keys.of_anchors(vectors), inner)
        order = np.argsort(lower, axis=1, kind="stable")
        ordered = np.take_along_axis(lower, order, axis=1)
        wanted = ((ordered <= reach[:, None]) & np.isfinite(ordered)).sum(axis=1)
        start = np.array(done)
        grown = np.where(start == 0, FIRST_CELLS, start * GROWTH)
        # Without a k-th row, or at first, only a few cells more.
        to = np.maximum(start, np.where((start == 0) | ~np.isfinite(best), np.minimum(wanted, grown), wanted))
        asked: dict[int, list[int]] = {}
        for i in np.flatnonzero(to > start).tolist():
            for c in order[i, start[i] : to[i]].tolist():
                asked.setdefault(c, []).append(i)
        if not asked:
            return None
        kind = next(t for t in ("<i2", "<i4", "<i8") if np.abs(vectors).max(initial=0) <= np.iinfo(t).max)
        return {"sids": list(sids), "labels": list(labels), "los": lo.tolist(), "his": hi.tolist(), "bounds": best.tolist(), "reach": reach.tolist(), "next": to.tolist(), "body": kind[1:].encode() + vectors.astype(kind).tobytes(), "cells": list(asked), "members": [np.array(m, "<u2").tobytes() for m in asked.values()]}

    types = pa.schema([("sids", pa.list_(pa.string())), ("labels", pa.list_(pa.int64())), *((n, pa.list_(pa.float64())) for n in ("los", "his", "bounds", "reach")), ("next", pa.list_(pa.int32())), ("body", pa.binary()), ("cells", pa.list_(pa.int32())), ("members", pa.list_(pa.binary()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
                held.append(row)
                if len(held) == GROUP:
                    if found := group(held):
                        yield pa.RecordBatch.from_pylist([found], schema=types)
                    held = []
        if held and (found := group(held)):
            yield pa.RecordBatch.from_pylist([found], schema=types)

    searches = open_.select("sid", "label", "v", "lo", "hi", "done", "bound")
    placed = bounded_batches(searches).mapInArrow(near, "sid string, label long, v array<long>, lo double, hi double, done int, bound double, pivot int, distance double")
    dealt = placed.repartitionByRange(shuffle_width(spark), "pivot", "distance", "sid").sortWithinPartitions("pivot", "distance", "sid")
    return stored(bounded_batches(dealt).mapInArrow(pack, PLANNED).withColumn("gid", F.monotonically_increasing_id()))


def best_in_block(scores: np.ndarray, fits: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(search, row) of the k best of each search among rows that fit and reach its least
    score; rows of one score in their order."""
    s = np.where(fits & (scores >= least[:, None]), scores, -np.inf)
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
        keep = (s >= kth[:, None]) & np.isfinite(s)
    else:
        keep = np.isfinite(s)
    i, j = np.nonzero(keep)
    order = np.lexsort((j, -s[i, j], i))
    i, j = i[order], j[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k]


def _scan(planned: DataFrame, index: DataFrame, keys: Keys, k: int, same: bool, width: int) -> DataFrame:
    """(sid, score, vec_id): what the planned searches find in the blocks of their cells."""
    pairs = planned.select("gid", F.explode(F.arrays_zip("cells", "members")).alias("x")).select("gid", F.col("x.cells").alias("block_cell"), F.col("x.members").alias("members"))
    pairs = pairs.join(index.select("block_cell", "block"), "block_cell").select("gid", "block", "members")
    groups = planned.select("gid", "sids", F.col("labels").alias("wanted"), "los", "his", "bounds", "reach", F.col("body").alias("anchors"))
    joined = pairs.join(groups, "gid").join(index, "block")
    names = ["sids", "wanted", "los", "his", "bounds", "reach", "anchors", "members", "block_cell", "low", "high", "ids", "labels", "body"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(c)[r].as_py() for c, n in enumerate(names)}
                own = np.frombuffer(row["members"], "<u2").astype(np.int64)
                anchors = _body(row["anchors"], width)[own]
                d = keys.of_anchors(anchors)[:, row["block_cell"] // BINS]
                close = np.maximum(row["low"] - d, d - row["high"]) <= np.array(row["reach"])[own]
                if not close.any():
                    continue
                own, anchors, rows = own[close], anchors[close], _body(row["body"], width)
                low, high = np.array(row["los"])[own], np.array(row["his"])[own]
                ids = row["ids"]
                labels, wanted = np.array(row["labels"]), np.array(row["wanted"])[own]
                scores = anchors @ rows.T
                fits = (labels == wanted[:, None]) == same
                fits &= scores <= high[:, None]
                i, j = best_in_block(scores, fits, np.maximum(low, np.array(row["bounds"])[own]), k)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([row["sids"][own[x]] for x in i.tolist()], pa.string()), pa.array(scores[i, j].astype(np.int64)), pa.array([ids[x] for x in j.tolist()], pa.int64())], ["sid", "score", "vec_id"])

    return bounded_batches(joined.select(*names)).mapInArrow(scan, "sid string, score long, vec_id long")


def _ranked(found: DataFrame, k: int, by: str = "sid") -> DataFrame:
    order = W.partitionBy(by).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def search(specs: DataFrame, index: DataFrame, keys: Keys, k: int, same: bool, width: int) -> DataFrame:
    """(sid, score, vec_id, nth): the k best rows of each of ``specs`` (sid, label, v, lo, hi)
    among those of the same label, or of another, with scores from lo to hi (null: any)."""
    specs = stored(specs)
    open_ = specs.withColumns({"done": F.lit(0), "bound": F.lit(None).cast("double")})
    best = None
    while True:
        planned = _plan(open_, keys, k, width)
        if not planned.limit(1).count():
            break
        found = _scan(planned, index, keys, k, same, width)
        best = stored(_ranked(found if best is None else found.unionByName(best.drop("nth")), k))
        state = planned.select(F.explode(F.arrays_zip("sids", "next")).alias("x")).select(F.col("x.sids").alias("sid"), F.col("x.next").alias("done"))
        kth = best.filter(F.col("nth") == k).select("sid", F.col("score").cast("double").alias("bound"))
        open_ = specs.join(state, "sid").join(kth, "sid", "left")
    return best if best is not None else specs.select("sid", F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("vec_id"), F.lit(1).alias("nth")).limit(0)


def mine_hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """For every anchor among ``rows`` (vec_id, label, v: integers) and each of its first
    ``positives`` rows of the same label: the first ``negatives`` rows of another label whose
    score is from ``least`` to ``most`` hundredths of the positive's."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    usable = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"), anchor.alias("is_anchor"))
    usable = usable.filter(F.col("label").isNotNull() & F.col("v").isNotNull()).withColumn("square", square).filter(F.col("square") < _EXACT)
    distinct = stored(usable.dropDuplicates(["vec_id", "label", "v"]))
    top, width = distinct.agg(F.max("square"), F.max(F.size("v"))).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if top is None:
        return rows.sparkSession.createDataFrame([], result)
    copies = W.partitionBy("label", "v").orderBy(F.col("vec_id").asc_nulls_last())
    few = distinct.withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= max(positives + 1, negatives))
    width = max(1, width)
    index, keys = _index(few, float(top), width)

    anchors = distinct.filter("is_anchor").select(F.col("vec_id").alias("anchor_id"), "label", "v", F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>"))).alias("sid"))
    anchors = stored(anchors)
    queries = anchors.dropDuplicates(["sid"]).select("sid", "label", "v", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    near = search(queries, index, keys, positives + 1, True, width).drop("nth")
    own = anchors.select("anchor_id", "sid").join(near, "sid").filter(~F.col("vec_id").eqNullSafe(F.col("anchor_id")))
    order = W.partitionBy("anchor_id", "sid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    chosen = own.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= positives)
    ring = F.concat_ws(":", F.col("sid"), F.col("score").cast("string"))
    chosen = stored(chosen.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "sid", ring.alias("ring")))

    low, high = F.expr(f"(positive_score * {least} + 99) div 100"), F.expr(f"(positive_score * {most}) div 100")
    rings = chosen.filter("positive_score >= 0").dropDuplicates(["ring"]).select("sid", "ring", low.cast("double").alias("lo"), high.cast("double").alias("hi")).filter("lo <= hi")
    rings = rings.join(queries.select("sid", "label", "v"), "sid").select(F.col("ring").alias("sid"), "label", "v", "lo", "hi")
    hard = search(rings, index, keys, negatives, False, width)
    hard = hard.select(F.col("sid").alias("ring"), F.col("score").alias("negative_score"), F.col("vec_id").alias("negative_id"), F.col("nth").cast("int").alias("rank"))
    return chosen.join(hard, "ring").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def quantised(embeddings: DataFrame, relabel: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of ``embeddings`` (vec_id, embedding, label): components times
    ``scale``, rounded down; labels of every ``relabel``-th id go to the next of ``labels``."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % relabel == 0, (label + 1) % labels).otherwise(label)
    # A component this large leaves its row out by its square.
    ints = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(_EXACT)), F.lit(-_EXACT))))
    return embeddings.filter(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), shifted.alias("label"), ints.alias("v"))


ORACLE = """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM usable a JOIN usable r ON a.vec_id % 50 = 0 AND r.vec_id IS DISTINCT FROM a.vec_id
), chosen AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id NULLS LAST) <= 5
)
SELECT c.anchor_id, c.positive_id, CAST(row_number() OVER (PARTITION BY c.anchor_id, c.positive_id ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank,
  s.vec_id AS negative_id, c.positive_score, s.score AS negative_score
FROM chosen c JOIN scored s ON s.anchor_id = c.anchor_id AND NOT s.same AND 50 * c.positive_score <= 100 * s.score AND 100 * s.score <= 95 * c.positive_score
QUALIFY row_number() OVER (PARTITION BY c.anchor_id, c.positive_id ORDER BY s.score DESC, s.vec_id NULLS LAST) <= 3
"""
