"""Benchmark decontamination by latent semantic retrieval.

1. Words (runs of letters, lower-cased) fall into 2^20 hash features. Document counts of
   all documents give their inverse document frequencies: small, but never 0, for the
   most frequent ones, so an item that many documents hold keeps its weight.
2. Items are cut into passages of at most half a window, so that a copy of a passage lies
   within one window, however long the item. The benchmark's passages form a TF-IDF
   matrix. A randomised SVD of it, with power iterations, runs over the distributed
   benchmark: each round sends a thin matrix out and adds up the parts' products. The
   latent space is spanned by the right singular vectors. The passages go in blocks of at most ``RANK``, each with a space of its own
   that spans them, so nothing is lost whatever the benchmark's size.
3. Windows of ``WINDOW`` words, half overlapping, of every whole text are the corpus's
   passages. Their cosine with a passage is scaled by the window's length over the
   passage's: so it is the share of the passage's weight that the window holds, and a
   short item in other text scores as a long one does. Windows whose words can't bring
   ``COSINE`` to any passage, by the largest shares in groups of passages, are done; the rest are projected, and their scaled cosine
   with all passages decides; a hit is a candidate for the passage's whole item. Who keeps
   half of an item's words keeps half of the words of one of its passages, at random
   about half its weight. (No strict bound: a paraphrase that keeps little but the most
   frequent words, under ``COSINE`` of each passage's weight, is not looked at.)
4. Candidates are verified on the words around the window: the longest common
   subsequence with the item, as a share of the item, and the answer check: the share of
   the words of the item's last sentence that are there.

A pair is a leak if the subsequence has ``COPY`` or more of the item, or ``PARAPHRASE`` or
more with at least ``ANSWER`` of the answer's words. Items of under ``SHORT`` words must be
there as a whole.

The benchmark must be small enough to send to every executor; ``MAX_BENCHMARK_BYTES`` is
checked, and a larger one is an error (call it with parts of it then). Beyond ``PART``
passages, every ``PART`` are a pass over the documents of their own.

Defined results: null texts have no words and no leaks; items without words leak
nowhere; repeated rows are judged alike; null doc_id is kept as null; other columns are
ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import textcore as tc
from lexiquarry.llm.common import bounded_batches, stored
from lexiquarry.llm.language import _lowered, _pieces, letter_words

FEATURES = 1 << 20
RANK = 256
#: Passages that one pass over the documents searches for (or those of one item).
PART = 1024
#: Parts of a block whose passages are ruled out together.
GROUPS = 24
WINDOW = 48
#: Least cosine, times the window's length over the passage's: the share of the
#: passage's weight that the window holds, whatever else it holds.
COSINE = 0.2
COPY = 0.75
PARAPHRASE = 0.5
ANSWER = 0.5
SHORT = 6
MAX_BENCHMARK_BYTES = 64 << 20
_U = np.uint64


def hashed_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of a slice's words, and each row's first word."""
    low = _lowered(data)
    starts, ends, first = letter_words(data, offs)
    return tc.hash_spans(low, starts, ends), first


def _features(words: np.ndarray) -> np.ndarray:
    return (words >> _U(44)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and for each feature those that have it. One number for each of a
    fixed number of features comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            data, offs = tc.utf8(b.column(0))
            n += b.num_rows
            seen_last, seen_set = -1, np.zeros(0, np.int64)
            for i, piece, o in _pieces(data, offs):
                words, first = hashed_words(piece, o)
                rows = i + np.repeat(np.arange(len(o) - 1), np.diff(first))
                keys = np.unique((rows << 20) | _features(words))
                f = keys & (FEATURES - 1)
                if len(o) == 2:  # pieces of one long row: count a feature once
                    seen_set = seen_set if seen_last == i else np.zeros(0, np.int64)
                    f = np.setdiff1d(f, seen_set, assume_unique=True)
                    seen_set, seen_last = np.union1d(seen_set, f), i
                total += np.bincount(f, minlength=FEATURES)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["f", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([n])], ["f", "c"])

    parts = bounded_batches(docs).select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "f long, c long")
    summed = parts.groupBy("f").agg(F.sum("c").alias("c")).toArrow()
    out, n = np.zeros(FEATURES, np.int64), 0
    f, c = summed["f"].to_numpy(), summed["c"].to_numpy()
    out[f[f >= 0]] = c[f >= 0]
    n = int(c[f < 0].sum())
    return n, out


@dataclass
class Block:
    """At most RANK passages in a latent space that they span. vocabulary: their features;
    basis: a row for each of these; shares: the largest share of a passage's weight that
    one such word brings, for each of GROUPS groups of passages; latent: the passages, over their squared length; lost: what the
    space leaves out of them, alike; items: the number of each one's item."""

    vocabulary: np.ndarray
    basis: np.ndarray
    shares: np.ndarray
    latent: np.ndarray
    lost: np.ndarray
    items: np.ndarray

    def opened(self) -> Block:
        self.active = np.zeros(FEATURES, bool)
        self.active[self.vocabulary] = True
        self.vectors = self.basis.astype(np.float32)
        return self


@dataclass
class Index:
    """What executors need. codes: 16 times the inverse document frequency of each
    feature; blocks: the passages' latent spaces; words and answers of items."""

    codes: np.ndarray
    blocks: list[Block]
    item_ids: list
    words: list[np.ndarray]
    answers: list[set[int]]

    def closed(self) -> dict:
        """Plain values, for a broadcast."""
        return dict(vars(self), blocks=[dict(vars(b)) for b in self.blocks])

    def opened(self) -> Index:
        """With look-up tables, for use."""
        self.idf = self.codes.astype(np.float32) / 16
        self.blocks = [(b if isinstance(b, Block) else Block(**b)).opened() for b in self.blocks]
        return self


def _item_words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return hashed_words(raw, np.array([0, len(raw)]))[0] if len(raw) else np.zeros(0, _U)


def _weights(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, TF-IDF weights and length of a passage."""
    f, n = np.unique(_features(words), return_counts=True)
    w = n * idf[f]
    return f, w, float(np.sqrt((w**2).sum()))


def randomised_svd(passages: DataFrame, idf: np.ndarray, keys: np.ndarray, rank: int, rounds: int = 1, seed: int = 11) -> np.ndarray:
    """Orthonormal bases (keys x rank) of the right singular vectors of each block's
    passages (block, words); keys are blocks' numbers before features, sorted."""
    known = idf[keys & (FEATURES - 1)]
    blocks = np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys >> 20)) + 1)
    thin = np.random.default_rng(seed).normal(size=(len(keys), rank + 8))
    sc = passages.sparkSession.sparkContext

    def orthonormal(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for at in blocks:
            q = np.linalg.qr(x[at])[0]
            out[at, : q.shape[1]] = q
        return out

    def product(q: np.ndarray) -> np.ndarray:
        """A'A q of all blocks, one part for each task."""
        sent = sc.broadcast((keys, known.astype(np.float32), q.astype(np.float32)))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features, weight, q_ = sent.value
            z = np.zeros(q_.shape)
            for b in batches:
                for block, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    f, n = np.unique(_features(np.array(x, np.int64).view(_U)), return_counts=True)
                    if len(f):
                        at = np.searchsorted(features, (block << 20) | f)
                        w = n * weight[at]
                        w = w / (np.sqrt((w**2).sum()) or 1.0)
                        z[at] += np.outer(w, w @ q_[at])
            rows = np.flatnonzero(z.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(z[rows]), pa.list_(pa.float64()))], ["i", "v"])

        cols = [F.sum(F.col("v")[k]).alias(f"c{k}") for k in range(q.shape[1])]
        got = passages.select("block", "words").mapInArrow(part, "i long, v array<double>").groupBy("i").agg(*cols).toArrow()
        out = np.zeros_like(q)
        if got.num_rows:
            out[got["i"].to_numpy()] = np.stack([got[f"c{k}"].to_numpy() for k in range(q.shape[1])], axis=1)
        sent.destroy()
        return out

    for _ in range(rounds):
        thin = orthonormal(product(orthonormal(thin)))
    last = product(thin)
    out = np.zeros((len(keys), rank))
    for at in blocks:
        _, vectors = np.linalg.eigh(thin[at].T @ last[at])
        out[at] = thin[at] @ vectors[:, ::-1][:, :rank]
    return out


def benchmark_items(benchmark: DataFrame) -> list[tuple]:
    """(item_id, words, text) of the items with words."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text, more than {MAX_BENCHMARK_BYTES}: give it in blocks")
    rows = benchmark.select("item_id", "text").collect()  # bounded above
    return [(r["item_id"], w, r["text"]) for r in rows if len(w := _item_words(r["text"] or ""))]


def frequency_codes(docs: DataFrame) -> np.ndarray:
    """16 times the inverse document frequency of each feature."""
    n, df = document_frequencies(docs)
    return np.clip(np.rint(np.log((2.0 + n) / (1.0 + df)) * 16), 1, 255).astype(np.uint8)


def _passages(words: np.ndarray) -> list[np.ndarray]:
    """An item in parts alike in size, of at most half a window."""
    return np.array_split(words, -(-len(words) // (WINDOW // 2)))


def _index(spark: SparkSession, items: list[tuple], codes: np.ndarray, rank: int) -> Index:
    idf = codes / 16.0
    pieces = [(i, part) for i, (_, words, _) in enumerate(items) for part in _passages(words)]
    count = -(-len(pieces) // rank)
    block = np.arange(len(pieces)) * count // len(pieces)
    keys = np.unique(np.concatenate([(b << 20) | _features(w) for b, (_, w) in zip(block, pieces, strict=True)]))
    passages = spark.createDataFrame([(int(b), w.view(np.int64).tolist()) for b, (_, w) in zip(block, pieces, strict=True)], "block long, words array<long>")
    basis = randomised_svd(passages, idf, keys, int(np.bincount(block).max()))
    blocks = []
    for b in range(count):
        at, of = np.flatnonzero(keys >> 20 == b), np.flatnonzero(block == b)
        vocabulary = keys[at] & (FEATURES - 1)
        shares, latent, lost = np.zeros((len(at), GROUPS), np.float32), np.zeros((len(of), basis.shape[1])), np.zeros(len(of))
        for k, i in enumerate(of):
            f, w, size = _weights(pieces[i][1], idf)
            slots = np.searchsorted(vocabulary, f)
            group = k * GROUPS // len(of)
            shares[slots, group] = np.maximum(shares[slots, group], w * idf[f] / size**2)
            latent[k] = (w / size**2) @ basis[at[slots]]
            lost[k] = np.sqrt(max(0.0, size**-2 - (latent[k] ** 2).sum()))
        blocks.append(Block(vocabulary, basis[at].astype(np.float16), shares, latent.astype(np.float32), lost.astype(np.float32), np.array([pieces[i][0] for i in of])))
    answers = []
    for _, _, text in items:
        sentences = [s for s in text.replace("\n", ". ").split(". ") if len(_item_words(s)) >= 2]
        answers.append(set(_item_words(sentences[-1] if sentences else text).tolist()))
    return Index(codes, blocks, [i for i, *_ in items], [w for _, w, _ in items], answers)


def build_index(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Index | None:
    """IDF of all documents, and the benchmark in its latent spaces."""
    items = benchmark_items(benchmark)
    return _index(docs.sparkSession, items, frequency_codes(docs), rank) if items else None


def build_indexes(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Iterator[Index]:
    """As build_index, in parts of a size that executors hold."""
    items = benchmark_items(benchmark)
    codes = frequency_codes(docs) if items else None
    part, size = [], 0
    for item in items:
        n = len(_passages(item[1]))
        if part and size + n > PART:
            yield _index(docs.sparkSession, part, codes, rank)
            part, size = [], 0
        part.append(item)
        size += n
    if part:
        yield _index(docs.sparkSession, part, codes, rank)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors over b."""
    at: dict[int, int] = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        m = at.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _candidates(words: np.ndarray, first: np.ndarray, index: Index, window: int, cosine: float):
    """(row, window's first word, item, scaled cosine) of the windows of a slice."""
    step = window // 2
    counts = np.diff(first)
    per_row = np.where(counts > 0, np.maximum(1, -(-(counts - window) // step) + 1), 0)
    row = np.repeat(np.arange(len(counts)), per_row)
    k = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = first[row] + k * step
    stop = np.minimum(start + window, first[row + 1])
    f = _features(words)
    w = index.idf[f].astype(np.float64)
    # A window is two halves; every half is summed once.
    halves = -(-counts // step)
    base = np.cumsum(halves) - halves
    half_row = np.repeat(np.arange(len(counts)), halves)
    half_at = first[half_row] + (np.arange(len(half_row)) - base[half_row]) * step
    half_end = np.minimum(half_at + step, first[half_row + 1])
    for block in index.blocks:
        active = block.active[f]
        before = np.concatenate([[0], np.cumsum(active)])
        slots = np.searchsorted(block.vocabulary, f[active])
        heavy = w[active].astype(np.float32)
        # No passage of a group can get more from a window than the group's largest shares
        # of its words.
        most = np.zeros((len(slots) + 1, block.shares.shape[1]))
        np.cumsum(block.shares[slots], axis=0, dtype=np.float64, out=most[1:])
        near = np.flatnonzero((most[before[stop]] - most[before[start]]).max(axis=1, initial=0.0) >= cosine - 1e-6)
        reach = np.concatenate([[0.0], np.cumsum(heavy, dtype=np.float64)])
        for c in range(0, len(near), 4096):
            part = near[c : c + 4096]
            one = base[row[part]] + k[part]
            two = one + 1
            has_two = k[part] + 1 < halves[row[part]]
            used = np.unique(np.concatenate([one, two[has_two]]))
            used = used[before[half_end[used]] > before[half_at[used]]]
            lo, sizes = before[half_at[used]], before[half_end[used]] - before[half_at[used]]
            at = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            rows = block.vectors[slots[at]]
            rows *= heavy[at][:, None]
            summed = np.zeros((len(used) + 1, rows.shape[1]), np.float32)  # the last stays 0
            summed[:-1] = np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0)

            def of(halfs: np.ndarray, used: np.ndarray = used, summed: np.ndarray = summed) -> np.ndarray:
                x = np.minimum(np.searchsorted(used, halfs), len(used) - 1)
                return summed[np.where(used[x] == halfs, x, len(used))]

            sums = of(one) + of(np.where(has_two, two, -1))
            length = (reach[before[stop[part]]] - reach[before[start[part]]]).astype(np.float32)
            upper = sums @ block.latent.T + np.outer(length, block.lost)
            for r, item in zip(*np.nonzero(upper >= cosine), strict=True):
                j = part[r]
                yield int(row[j]), int(start[j]), int(block.items[item]), float(upper[r, item])


def _cosine(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    f, v, size = _weights(a, idf)
    g, w, length = _weights(b, idf)
    _, i, j = np.intersect1d(f, g, assume_unique=True, return_indices=True)
    return float((v[i] * w[j]).sum() / (size * length))


def leaks_of(words: np.ndarray, first: np.ndarray, index: Index, window: int = WINDOW, cosine: float = COSINE) -> dict[tuple[int, int], tuple[float, float, float, int]]:
    """(row, item) to (cosine, subsequence share, answer share, first word) of the leaks."""
    out: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for row, start, item in sorted({c[:3] for c in _candidates(words, first, index, window, cosine)}):
        if (row, item) in out and out[row, item][1] == 1:
            continue
        target = index.words[item]
        n = len(target)
        a, b = max(int(first[row]), start - n), min(int(first[row + 1]), start + window + n)
        near, sought = words[a:b].tolist(), target.tolist()
        have = set(near)
        if sum(map(have.__contains__, sought)) < PARAPHRASE * n:  # nor can a subsequence be longer
            continue
        share = common_subsequence(near, sought) / n
        answer = len(index.answers[item] & have) / max(1, len(index.answers[item]))
        if share >= COPY or (share >= PARAPHRASE and answer >= ANSWER):
            if n < SHORT and share < 1:
                continue
            if (row, item) not in out or share > out[row, item][1]:
                score = _cosine(words[start : min(start + window, int(first[row + 1]))], target, index.idf)
                out[row, item] = (score, share, answer, start - int(first[row]))
    return out


def _scan(column: pa.Array, index: Index) -> Iterator[tuple[int, int, tuple[float, float, float, int]]]:
    """(row, item, facts) of a batch."""
    data, offs = tc.utf8(column)
    for i, j in tc.slices(offs, 1 << 19):
        piece, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        words, first = hashed_words(piece, o)
        for (row, item), facts in leaks_of(words, first, index).items():
            yield i + row, item, facts


LEAKS = "doc_id long, item_id long, cosine double, lcs double, answer double, start_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """One row for each document row and benchmark item that it holds."""
    out = None
    for index in build_indexes(docs, benchmark, rank):
        found = _leaks_by(docs, index)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], LEAKS) if out is None else out


def _leaks_by(docs: DataFrame, index: Index) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index.closed())  # bounded by FEATURES, RANK and PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = Index(**sent.value).opened()
        for b in batches:
            ids = b.column(0)
            rows = [(ids[r].as_py(), ix.item_ids[k], *facts) for r, k, facts in _scan(b.column(1), ix)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "cosine", "lcs", "answer", "start_word"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, LEAKS)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; nothing is shuffled."""
    out = docs
    for k, index in enumerate(build_indexes(docs, benchmark, rank)):
        out = _kept_by(stored(out) if k else out, index)
    return out


def _kept_by(docs: DataFrame, index: Index) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index.closed())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = Index(**sent.value).opened()
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for r, _, _ in _scan(b.column(at), ix):
                keep[r] = False
            yield b.filter(pa.array(keep))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
