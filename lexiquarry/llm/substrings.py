"""Substring dedup: suffix automata of reference shards, and matching statistics.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window that
covers it also starts in a document with a smaller doc_id.

1. Every window has a seed: the least hash among its runs of ``GRAM`` words. Equal
   windows have equal seeds, and neighbours mostly share one, so seeds are few. An
   aggregation finds the seeds of several documents and the first of these, the owner.
2. An owner's windows under such seeds are reference text. Other documents' windows
   under them are query segments, cut where the owner changes.
3. Reference text and segments meet by owner. A shard's suffix automaton (over words,
   not hashes) is built, the segments stream over it, and wherever the match is at
   least a window long, the window is in the owner's text. Owners with many segments
   get several salts, each with the reference text again.
4. Windows that share the owner's seed but not its text are left over: windows of later
   variants. Their 128-bit hashes are grouped, and those of later documents go too.

The automata travel by shuffle, not by broadcast: reference text grows with the corpus,
so a broadcast of it has no bound.

Defined results: null text has no words; a text without a whole window keeps all words;
documents that share a doc_id do not remove each other's words; null doc_id counts as
the largest; a text of any length is read whole; other columns are ignored, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm import textcore as tc
from lexiquarry.llm.common import bounded_batches, row_key, shuffle_width, stored

WINDOW = 50
#: Words of the runs of which a window's least one is its seed.
GRAM = 16
#: Words of reference text in one automaton.
SHARD_WORDS = 50_000
#: Words of query segments for one salt of an owner.
SALT_WORDS = 100_000
_LAST = (1 << 63) - 1


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def window_seeds(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The seed of the window that starts at each word."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    return _least(tc.rolling_hashes(words, gram), window - gram + 1)


class SuffixAutomaton:
    """All substrings of a list of symbol sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self._last = 0
        self._breaks = 0

    def _add(self, c) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[self._last] + 1)
        link.append(0)
        p = self._last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self._last = cur

    def add(self, sequence) -> None:
        """Another sequence; no match runs on from one to the next."""
        for c in sequence:
            self._add(c)
        self._add(self._breaks)  # an integer, never a word
        self._breaks += 1

    def matching_statistics(self, sequence) -> list[int]:
        """For each place the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for c in sequence:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(c)
            if to is None:
                n = 0
            else:
                state = to
                n += 1
            out.append(n)
        return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


SEEDS = "seed long, id long, th long"
PIECES = "kind int, doc_id long, id long, th long, n_words long, start long, owner long, body binary, sha string"
FOUND = "kind int, id long, th long, a long, b long, h1 long, h2 long"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """n_words, n_removed and the digest of the kept words of every document."""
    base = bounded_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
        row_key().alias("th"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = tc.utf8(b.column(2))
            ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in tc.slices(offs):
                data, o = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                starts, ends, first = tc.word_spans(data, o)
                s = window_seeds(tc.hash_spans(data, starts, ends), window, gram)
                if not len(s):
                    continue
                rows = np.repeat(np.arange(j - i), np.diff(first))
                keep = rows[: len(s)] == rows[window - 1 :]
                keep[1:] &= (s[1:] != s[:-1]) | (rows[1 : len(s)] != rows[: len(s) - 1]) | ~(rows[: len(s) - 1] == rows[window - 1 : -1])
                at = i + rows[: len(s)][keep]
                yield pa.RecordBatch.from_arrays([pa.array(tc.signed(s[keep])), pa.array(ids[at]), pa.array(ths[at])], ["seed", "id", "th"])

    found = stored(base.select("id", "th", "text").mapInArrow(seeds, SEEDS))
    shared = stored(found.groupBy("seed").agg(F.min("id").alias("owner"), F.max("id").alias("hi")).filter("owner < hi").select("seed", "owner"))
    hits = found.join(shared, "seed").groupBy("id", "th").agg(F.collect_set(F.struct("seed", "owner")).alias("hits"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "id", "th", "n_words", "start", "owner", "body", "sha"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            doc_ids, ids, ths = (b.column(i).to_pylist() for i in range(3))
            texts, held = b.column(3), b.column(4)
            rows, size = [], 0
            for k in range(b.num_rows):
                raw = texts[k].as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                words = raw.split()
                own = np.zeros(0, np.int64)
                mine = held[k]
                if mine.is_valid and len(words) >= window:
                    pairs = mine.values
                    seed, owner = pairs.field(0).to_numpy(), pairs.field(1).to_numpy()
                    order = np.argsort(seed)
                    seed, owner = seed[order], owner[order]
                    data = np.frombuffer(raw, np.uint8)
                    starts, ends, _ = tc.word_spans(data, np.array([0, len(data)]))
                    s = tc.signed(window_seeds(tc.hash_spans(data, starts, ends), window, gram))
                    at = np.minimum(np.searchsorted(seed, s), len(seed) - 1)
                    own = np.where(seed[at] == s, owner[at], -_LAST)
                if not (own < ids[k]).any() or not ((own < ids[k]) & (own != -_LAST)).any():
                    rows.append((0, doc_ids[k], ids[k], ths[k], len(words), None, None, None, hashlib.sha256(b" ".join(words)).hexdigest()))
                else:
                    rows.append((1, doc_ids[k], ids[k], ths[k], len(words), None, None, raw, None))
                    edges = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
                    for p, q in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        o = int(own[p])
                        if o != -_LAST and o != ids[k]:
                            body = b" ".join(words[p : q + window - 1])
                            rows.append((3, None, ids[k], ths[k], q - p + window - 1, p, o, body, None))
                            size += len(body)
                for p, q in _runs(own == ids[k]):
                    body = b" ".join(words[p : q + window - 1])
                    rows.append((2, None, ids[k], ths[k], q - p + window - 1, p, ids[k], body, None))
                    size += len(body)
                size += len(raw)
                if size > 4 * tc.SLICE_BYTES:
                    yield pack(rows)
                    rows, size = [], 0
            if rows:
                yield pack(rows)

    parts = stored(base.join(hits.hint("shuffle_hash"), ["id", "th"], "left").select("doc_id", "id", "th", "text", "hits").mapInArrow(pieces, PIECES))
    segments = parts.filter("kind = 3").select("kind", "owner", "id", "th", "start", "body", "n_words")
    hot = stored(segments.groupBy("owner").agg(F.sum("n_words").alias("load")).filter(F.col("load") > SALT_WORDS).select("owner", F.ceil(F.col("load") / SALT_WORDS).cast("int").alias("salts")))
    salted = segments.join(hot, "owner", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "th", "start"), F.col("salts")), F.lit(0)).cast("int"))
    reference = parts.filter("kind = 2").select("kind", "owner", "id", "th", "start", "body", "n_words").join(hot, "owner", "left")
    reference = reference.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    met = salted.unionByName(reference).select("owner", "salt", "kind", "id", "th", "start", "body").repartition(shuffle_width(docs.sparkSession), "owner", "salt").sortWithinPartitions("owner", "salt", "kind")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of (owner, salt), reference rows first. The segments of a group are a
        salt's worth; its automata are built one after the other."""
        names = ["kind", "id", "th", "a", "b", "h1", "h2"]

        def shards(texts: list[bytes]) -> Iterator[SuffixAutomaton]:
            auto, n = SuffixAutomaton(), 0
            for t in texts:
                words = t.split()
                step = SHARD_WORDS - window + 1
                for p in range(0, max(1, len(words) - window + 1), step):
                    piece = words[p : p + SHARD_WORDS]
                    if n and n + len(piece) > SHARD_WORDS:
                        yield auto
                        auto, n = SuffixAutomaton(), 0
                    auto.add(piece)
                    n += len(piece)
            if n:
                yield auto

        def settle(refs: list[bytes], asked: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            seqs = [body.split() for *_, body in asked]
            hit = [np.zeros(len(s) - window + 1, bool) for s in seqs]
            for auto in shards(refs):
                for s, h in zip(seqs, hit, strict=True):
                    h |= np.array(auto.matching_statistics(s))[window - 1 :] >= window
            cover: list[tuple[int, int, int, int]] = []
            left_id, left_th, left_at, left_1, left_2 = [], [], [], [], []
            for (id_, th, start, body), h in zip(asked, hit, strict=True):
                cover += [(id_, th, start + p, start + q + window - 1) for p, q in _runs(h)]
                if not h.all():
                    data = np.frombuffer(body, np.uint8)
                    starts, ends, _ = tc.word_spans(data, np.array([0, len(data)]))
                    words = tc.hash_spans(data, starts, ends)
                    rest = ~h
                    left_1.append(tc.signed(tc.rolling_hashes(words, window)[rest]))
                    left_2.append(tc.signed(tc.rolling_hashes(tc.mix64(words + np.uint64(0x5851F42D4C957F2D)), window, 7)[rest]))
                    at = start + np.flatnonzero(rest)
                    left_at.append(at)
                    left_id.append(np.full(len(at), id_, np.int64))
                    left_th.append(np.full(len(at), th, np.int64))
            m = sum(len(x) for x in left_at)
            cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
            own = np.array(cover, np.int64).reshape(-1, 4)
            n = len(own)
            at = cat(left_at)
            blank = np.zeros(n, np.int64)
            cols = [np.concatenate([np.zeros(n, np.int32), np.ones(m, np.int32)])]
            cols += [np.concatenate([own[:, 0], cat(left_id)]), np.concatenate([own[:, 1], cat(left_th)]), np.concatenate([own[:, 2], at]), np.concatenate([own[:, 3], at + window])]
            cols += [np.concatenate([blank, cat(left_1)]), np.concatenate([blank, cat(left_2)])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        key, refs, asked = None, [], []
        for b in batches:
            owner, salt, kind, ids, ths, start = (b.column(i).to_pylist() for i in range(6))
            for i in range(b.num_rows):
                if (owner[i], salt[i]) != key:
                    if asked:
                        yield settle(refs, asked)
                    key, refs, asked = (owner[i], salt[i]), [], []
                body = b.column(6)[i].as_py()
                if kind[i] == 2:
                    refs.append(body)
                else:
                    asked.append((ids[i], ths[i], start[i], body))
        if asked:
            yield settle(refs, asked)

    seen = stored(met.mapInArrow(stream, FOUND))
    left = seen.filter("kind = 1")
    first = stored(left.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("h1", "h2", "lo"))
    later = left.join(first, ["h1", "h2"]).filter("id > lo").select("id", "th", "a", "b")
    spans = seen.filter("kind = 0").select("id", "th", "a", "b").unionByName(later).groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids, counts = b.column(0).to_pylist(), b.column(1).to_pylist()
            removed, shas = [], []
            for k in range(b.num_rows):
                words = b.column(2)[k].as_py().split()
                edge = np.zeros(len(words) + 1, np.int64)
                mine = b.column(3)[k]
                if mine.is_valid:
                    np.add.at(edge, mine.values.field(0).to_numpy(), 1)
                    np.add.at(edge, mine.values.field(1).to_numpy(), -1)
                stay = np.cumsum(edge)[:-1] == 0
                removed.append(len(words) - int(stay.sum()))
                shas.append(hashlib.sha256(b" ".join(compress(words, stay.tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    touched = parts.filter("kind = 1").select("doc_id", "n_words", "body", "id", "th").join(spans.hint("shuffle_hash"), ["id", "th"], "left")
    done = touched.select("doc_id", "n_words", "body", "spans").mapInArrow(keep, RESULT)
    whole = parts.filter("kind = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return whole.unionByName(done)
