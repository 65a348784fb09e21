"""Near-duplicate documents by ProbMinHash.

A document is the weighted set of its shingles (five words; a shorter text is one
shingle), each weighing 1 + ln(occurrences). Every shingle is a Poisson process of
that rate whose arrivals depend on the shingle alone and fall on random registers; a
register keeps the shingle that arrives first. Two registers agree with the probability
Jaccard of the sets. Arrivals stop at a limit that fills all registers but rarely; a
document that isn't filled goes on with twice the limit, so results don't depend on it.

Registers are cut in bands. Documents with an equal band are candidates; a link is a
pair whose Jaccard similarity of distinct shingles, over the texts, is ``threshold`` or
more. Classes are the connected components of links.

Copies (equal shingle sets) are one representative first. In a bucket every member is
compared with the bucket's first member. Members that then are in another component
than the first are compared with all members of other components; a sketch of parities
(a bound on the symmetric difference) sorts out those that can't reach the threshold.
So all candidate pairs of different components are decided, without all pairs of a group.

Defined results: texts without words (null, empty) are equal to each other; a document
without links is a class of its own; rows with the same doc_id and text are one class;
null doc_id counts as the largest id; other columns are ignored, whatever their names; a
text of any length is read as a whole, its shingles in one worker's memory; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm import textcore as tc
from lexiquarry.llm.common import bounded_batches, row_key, stored
from lexiquarry.llm.components import connected_components

THRESHOLD = 0.8
SHINGLE_WORDS = 5
BANDS = 24
BAND_ROWS = 4
#: Longs in a parity sketch.
PARITY_LONGS = 16
_LAST = (1 << 63) - 1
_U = np.uint64


def _uniform(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from mixed 64-bit values."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def probminhash(values: np.ndarray, weights: np.ndarray, rows: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """Registers of every row (n_rows x registers); rows without elements stay 0."""
    total = np.bincount(rows, weights, n_rows)
    limit = np.divide(registers * (np.log(registers) + 5.0), total, out=np.zeros(n_rows), where=total > 0)
    out = np.zeros((n_rows, registers), _U)
    open_rows = total > 0
    while open_rows.any():
        live = np.flatnonzero(open_rows[rows])
        v, w, r = values[live], weights[live], rows[live]
        t, j = np.zeros(len(v)), 0
        firsts = np.full(n_rows * registers, np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(v):
            j += 1
            with np.errstate(over="ignore"):
                x = tc.mix64(v + _U(j) * _U(0x9E3779B97F4A7C15))
            t = t - np.log(_uniform(x)) / w
            on = t < limit[r]
            v, w, r, t, x = v[on], w[on], r[on], t[on], x[on]
            if len(v):
                at = r * registers + (tc.mix64(x ^ _U(0xA5A5A5A5)) % _U(registers)).astype(np.int64)
                np.minimum.at(firsts, at, t)
                found.append((at, t, v))
        for at, t_, v_ in found:
            best = t_ == firsts[at]
            out.reshape(-1)[at[best]] = v_[best]
        filled = np.isfinite(firsts).reshape(n_rows, registers).all(axis=1)
        open_rows = open_rows & ~filled
        limit = np.where(open_rows, limit * 2, limit)
    return out


def band_hashes(signature: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    s = signature.reshape(len(signature), bands, band_rows)
    out = np.zeros(s.shape[:2], _U)
    with np.errstate(over="ignore"):
        for i in range(band_rows):
            out = tc.mix64(out * _U(0x9E3779B97F4A7C55) + s[:, :, i] + _U(i + 1))
    return out


def _sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the rows of a slice: values, rows, counts."""
    starts, ends, first = tc.word_spans(data, offs)
    return tc.distinct_by_row(*tc.shingles(tc.hash_spans(data, starts, ends), first, size))


SIGNED = f"id long, th long, h1 long, h2 long, n int, bands array<long>, {', '.join(f'p{i} long' for i in range(PARITY_LONGS))}"
_PARITY = [f"p{i}" for i in range(PARITY_LONGS)]


def _differs(a: str, b: str):
    """A lower bound of the symmetric difference of two sets."""
    total = F.lit(0)
    for p in _PARITY:
        total = total + F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}")))
    return total


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE_WORDS, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, th (tells rows with one doc_id apart), class_id, class_th and is_kept."""
    base = bounded_batches(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
        row_key().alias("th"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = tc.utf8(b.column(2))
            ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in tc.slices(offs):
                m = j - i
                values, rows, counts = _sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
                n = np.bincount(rows, minlength=m)
                signature = probminhash(values, 1.0 + np.log(counts), rows, m, bands * band_rows)
                cuts = band_hashes(signature, bands, band_rows)
                edges = np.concatenate([[0], np.cumsum(n)])
                sums = []
                with np.errstate(over="ignore"):
                    for salt in (_U(0x1234567), _U(0x89ABCDEF012)):
                        acc = np.concatenate([np.zeros(1, _U), np.cumsum(tc.mix64(values ^ salt), dtype=_U)])
                        sums.append(tc.signed(tc.mix64(acc[edges[1:]] - acc[edges[:-1]] + n.astype(_U))))
                bit = (tc.mix64(values ^ _U(0x77777)) % _U(PARITY_LONGS * 64)).astype(np.int64)
                flips = (np.bincount(rows * (PARITY_LONGS * 64) + bit, minlength=m * PARITY_LONGS * 64) & 1).astype(np.uint8)
                parity = np.packbits(flips.reshape(m, PARITY_LONGS * 64), axis=1).view(np.int64).reshape(m, PARITY_LONGS)
                flat = pa.array(tc.signed(cuts[n > 0].reshape(-1)))
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
                cols = [pa.array(ids[i:j]), pa.array(ths[i:j]), pa.array(sums[0]), pa.array(sums[1]), pa.array(n.astype(np.int32)), lists]
                cols += [pa.array(np.ascontiguousarray(parity[:, k])) for k in range(PARITY_LONGS)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "th", "h1", "h2", "n", "bands", *_PARITY])

    signed = stored(base.mapInArrow(sign, SIGNED))
    first = F.min_by(F.struct("n", "bands", *_PARITY), F.struct("id", "th"))
    reps = stored(signed.groupBy("h1", "h2").agg(F.min(F.struct("id", "th")).alias("k"), first.alias("x")).select("h1", "h2", "k", "x.n", "x.bands", F.struct(*[F.col(f"x.{p}").alias(p) for p in _PARITY]).alias("x")))
    rows = reps.select("k", F.posexplode("bands").alias("band", "bh"))
    heads = stored(rows.groupBy("band", "bh").agg(F.min("k").alias("head"), F.count("*").alias("c")).filter("c > 1").select("band", "bh", "head"))
    member = stored(rows.join(heads, ["band", "bh"]))

    what = reps.select("k", "n", "x")
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    most = F.col("na") + F.col("nb") - 2 * F.ceil((F.col("na") + F.col("nb")) * threshold / (1 + threshold) - 1e-9)

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes and parities leave open."""
        p = pairs.join(what.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("x").alias("xa")), "a")
        p = p.join(what.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("x").alias("xb")), "b")
        return p.filter((low >= F.lit(threshold) * high) & (_differs("xa", "xb") <= most)).select("a", "b")

    star = stored(possible(member.filter("k != head").select(F.col("k").alias("a"), F.col("head").alias("b")).distinct()))

    def cut_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = tc.utf8(b.column(2))
            for i, j in tc.slices(offs):
                values, rows, _ = _sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
                offsets = np.searchsorted(rows, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tc.signed(values)))], ["id", "th", "shingles"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among the pairs, by the texts' whole shingle sets."""
        who = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct().select("k.id", "k.th")
        texts = base.join(who.hint("shuffle_hash"), ["id", "th"]).mapInArrow(cut_shingles, "id long, th long, shingles array<long>")
        sets = stored(texts.groupBy("id", "th").agg(F.first("shingles").alias("shingles")).select(F.struct("id", "th").alias("k"), "shingles"))
        p = pairs.join(sets.select(F.col("k").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("shingles").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        return p.withColumn("both", both).filter(F.col("both") >= F.lit(threshold) * (F.size("sa") + F.size("sb") - F.col("both")) - 1e-9).select("a", "b")

    links = stored(verified(star))
    labels = connected_components(links)
    placed = member.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
    mixed = placed.groupBy("band", "bh").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("band", "bh")
    open_ = stored(placed.join(mixed, ["band", "bh"]).join(labels.select(F.col("k").alias("head"), F.col("label").alias("head_label")), "head", "left").withColumn("head_label", F.coalesce("head_label", "head")))
    sized = open_.join(what, "k")
    left = sized.filter("label != head_label").select("band", "bh", F.col("k").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("x").alias("xa"))
    right = sized.select("band", "bh", F.col("k").alias("b"), F.col("label").alias("lb"), "head_label", F.col("n").alias("nb"), F.col("x").alias("xb"))
    new = (F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("head_label")) | (F.col("a") < F.col("b"))) & (F.col("b") != F.col("a"))
    rest = left.join(right, (left["band"] == right["band"]) & (left["bh"] == right["bh"]) & new & (low >= F.lit(threshold) * high) & (_differs("xa", "xb") <= most))
    rest = stored(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if rest.limit(1).count():
        links = links.unionByName(stored(verified(rest)))
        labels = connected_components(links)
    classes = reps.select("h1", "h2", "k").join(labels, "k", "left").select("h1", "h2", F.coalesce("label", "k").alias("label"))
    out = signed.select("id", "th", "h1", "h2").join(classes, ["h1", "h2"])
    null_id = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return out.select(
        null_id("id").alias("doc_id"),
        "th",
        null_id("label.id").alias("class_id"),
        F.col("label.th").alias("class_th"),
        ((F.col("id") == F.col("label.id")) & (F.col("th") == F.col("label.th"))).alias("is_kept"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, the one with the least doc_id."""
    kept = stored(near_duplicate_classes(docs, **options).filter("is_kept").select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "th").distinct())
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), row_key().alias("th"))
    return keyed.join(kept.hint("shuffle_hash"), ["id", "th"]).dropDuplicates(["id", "th"]).select("row.*")
