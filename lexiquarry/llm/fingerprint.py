"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the k smallest distinct 48-bit hashes of a text's shingles (five words; a
shorter text is one shingle) and how many distinct shingles it stands for: exact up to
k, estimated beyond. Sketches of parts merge into the sketch of the whole. From two of
them come resemblance, containment and distinct counts. Written down, a sketch is
``<distinct>:<base64 of the sorted hashes, 6 bytes each>``.

Defined results: null text is the empty text, whose sketch is ``0:``; two empty
sketches resemble each other by 1.0, an empty and another one by 0.0. Documents follow
each other by doc_id (null last), rows with the same doc_id by text. After the last
document comes the first, so a lone document is followed by itself. Repeated rows follow
each other. A text of any length is read whole; texts go through a worker a few at a time.
Other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm import textcore as tc
from lexiquarry.llm.common import cut, shuffle_width

#: Hashes that a sketch keeps.
K = 128
SHINGLE_WORDS = 5
_TOP = 1 << 48


def sketch_rows(data: np.ndarray, offs: np.ndarray, k: int = K, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each row of a slice its k + 1 smallest distinct hashes, or all if fewer."""
    starts, ends, first = tc.word_spans(data, offs)
    words = tc.hash_spans(data, starts, ends)
    values, rows = tc.shingles(words, first, size)
    values = values >> np.uint64(16)
    n = len(offs) - 1
    counts = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
    limit = np.full(n, _TOP, np.uint64)
    large = counts > 4 * k
    limit[large] = ((2 * k + 64) / counts[large] * _TOP).astype(np.uint64)
    low = values < limit[rows]
    kept, owner, _ = tc.distinct_by_row(values[low], rows[low])
    edges = np.searchsorted(owner, np.arange(n + 1))
    out = []
    for i in range(n):
        mine = kept[edges[i] : edges[i + 1]]
        if large[i] and len(mine) <= k:  # many repeats: all hashes of this row
            mine = np.unique(values[rows == i])
        out.append(mine[: k + 1])
    return out


def distinct_count(hashes: np.ndarray, k: int = K) -> int:
    """Distinct shingles behind the k + 1 smallest hashes."""
    if len(hashes) <= k:
        return len(hashes)
    return round((k - 1) * _TOP / float(hashes[k - 1]))


def encode(hashes: np.ndarray, distinct: int, k: int = K) -> str:
    body = hashes[:k].astype(">u8").tobytes()
    body = np.frombuffer(body, np.uint8).reshape(-1, 8)[:, 2:].tobytes() if len(hashes) else b""
    return f"{distinct}:{base64.b64encode(body).decode()}"


def decode(text: str) -> tuple[int, np.ndarray]:
    count, _, body = text.partition(":")
    raw = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return int(count), wide.reshape(-1).view(">u8").astype(np.uint64)


def merge(a: str, b: str, k: int = K) -> str:
    """The sketch of two parts together. (Shingles across the seam belong to neither.)"""
    (na, ha), (nb, hb) = decode(a), decode(b)
    both = np.union1d(ha, hb)
    if na <= k and nb <= k and len(both) <= k:
        return encode(both, len(both), k)
    return encode(both, round((k - 1) * _TOP / float(both[:k][-1])), k)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard: the share of the k smallest of the union that are in both (exact if all are kept)."""
    a, b = a[:k], b[:k]
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)
    if len(a) == k or len(b) == k:
        union = union[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right")) / len(union)


def containment(a: str, b: str, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    (na, ha), (nb, hb) = decode(a), decode(b)
    if not na:
        return 1.0
    j = resemblance(ha, hb, k)
    return min(1.0, j * (na + nb) / (1 + j) / na)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles long"


def _neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """Documents dealt out by ranges of doc_id; the first documents of a range also go,
    marked, to the range before, where they follow its last one."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("inf")))
    cuts = d.select(place.alias("at")).filter(F.col("at") < float("inf")).agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 10000)).first()[0] if parts > 1 else None
    bounds = sorted(set(cuts or [])) or [0.0]
    splits = [float("-inf"), *bounds, float("inf")]
    d = d.withColumn("at", place)
    d = Bucketizer(splits=splits, inputCol="at", outputCol="part", handleInvalid="keep").transform(d).withColumn("part", F.col("part").cast("int"))
    found = d.groupBy("part").agg(F.min("at").alias("at")).collect()  # one row for each range
    order = sorted((r["part"], r["at"]) for r in found)
    heads = [(at, order[i - 1][0]) for i, (_, at) in enumerate(order)]
    if not heads:
        return d.withColumn("ahead", F.lit(0)).limit(0)
    heads_df = F.broadcast(d.sparkSession.createDataFrame(heads, "at double, to_part int"))
    d = d.join(heads_df, "at", "left")
    both = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("ahead")), F.struct(F.col("to_part").alias("part"), F.lit(1).alias("ahead")))
    return d.select("doc_id", "text", F.explode(F.filter(both, lambda x: x["part"].isNotNull())).alias("x")).select("doc_id", "text", "x.part", "x.ahead")


def fingerprint_documents(docs: DataFrame, k: int = K, size: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every document of ``docs`` (doc_id, text) and of its edited text."""
    spark = docs.sparkSession
    parts = max(2, shuffle_width(spark))
    dealt = _neighbours(docs, parts).repartition(parts, "part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_last(), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def sketches(texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        return sketch_rows(np.frombuffer(b"".join(raw), np.uint8), offs, k, size)

    def work(pending: list[tuple], nxt: str | None) -> pa.RecordBatch:
        """pending: (doc_id, text) in order; nxt: the text after the last."""
        texts = [t for _, t in pending]
        after = [*texts[1:], nxt]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after, strict=True)]
        own = sketches([*texts, nxt])
        new = sketches(edited)
        rows = []
        for i, (doc_id, t) in enumerate(pending):
            n = distinct_count(own[i], k)
            rows.append((doc_id, len(t), hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest(), encode(own[i], n, k), encode(new[i], distinct_count(new[i], k), k), resemblance(own[i], new[i], k), resemblance(own[i], own[i + 1], k), n))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, pending = None, 0, []
        done = True
        for b in batches:
            ids, parts_, aheads, texts = b.column(0), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(1)
            for i in range(b.num_rows):
                if parts_[i] != part:
                    part, pending, held, done = parts_[i], [], 0, False
                if done:
                    continue
                text = texts[i].as_py()
                if aheads[i]:
                    if pending:
                        yield work(pending, text)
                    pending, held, done = [], 0, True
                    continue
                if pending and held + len(text) > tc.SLICE_BYTES:
                    yield work(pending, text)
                    pending, held = [], 0
                pending.append((ids[i].as_py(), text))
                held += len(text)

    return dealt.select("doc_id", "text", "part", "ahead").mapInArrow(run, SCHEMA)
