"""Language identification of words and documents by a linear-chain CRF.

A word is a run of letters (ASCII letters and all bytes of other characters), ASCII and
Latin-1 letters lower-cased. Its features are hashed: first 1 to 3 and last 1 to 4
bytes, the whole word (the lexicon), and its byte trigrams. Transitions between the
languages of neighbouring words are learned; forward-backward over chains of at most
``CHAIN`` words gives each word's posteriors, and a document takes the language with
the largest mean. So a code-switched text has labels for each word. A chain starts anew
after ``CHAIN`` words, and a text of over ``PIECE`` bytes is read in pieces, each with
chains of its own: a word near such a start has its neighbours on one side only.

The model is fitted on at most ``SAMPLE`` labelled documents of at most ``SAMPLE_CHARS``
characters, those with the least hash of their doc_id, and on as many chains that join
runs of words of several of them, so that switches are learned. Only text and lang are
used.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is
everything when there is no labelled row. Repeated rows are judged alike; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm import textcore as tc
from lexiquarry.llm.common import bounded_batches
from lexiquarry.llm.crf import Crf, chains, fit, forward_backward

SAMPLE = 600
SAMPLE_CHARS = 20_000
BUCKETS = 1 << 17
CHAIN = 64
#: A document whose language scores less is rejected (four languages even are 0.25).
LEAST_SCORE = 0.3
#: Bytes looked at together; a longer text goes in pieces.
PIECE = 1 << 19

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def _lowered(data: np.ndarray) -> np.ndarray:
    out = _LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    upper = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[upper] += 0x20
    return out


def letter_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and for each row its first word, as textcore.word_spans."""
    blank = np.where(_LETTER[data], np.uint8(97), np.uint8(32))
    return tc.word_spans(blank, offs)


def _affixes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Buckets of the whole-word and affix features, one array for each feature."""
    up, down = tc._powers(len(low) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(low) + 1, _U)
        np.cumsum((low.astype(_U) + _U(1)) * up[: len(low)], out=total[1:])

        def bucket(s, e, salt):
            return (tc.mix64(((total[e] - total[s]) * down[s]) ^ _U(salt)) & _U(BUCKETS - 1)).astype(np.int64)

        out = [bucket(starts, ends, 11)]
        out += [bucket(starts, np.minimum(starts + k, ends), 100 + k) for k in (1, 2, 3)]
        out += [bucket(np.maximum(ends - k, starts), ends, 200 + k) for k in (1, 2, 3, 4)]
    return out


def _trigrams(low: np.ndarray) -> np.ndarray:
    x = low.astype(_U)
    with np.errstate(over="ignore"):
        g = (x[:-2] | (x[1:-1] << _U(8)) | (x[2:] << _U(16))) * _U(0x9E3779B97F4A7C15)
    return (g >> _U(64 - 17)).astype(np.int64)


def word_scores(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    scores = np.zeros((len(starts), weights.shape[1]), np.float32)
    for b in _affixes(low, starts, ends):
        scores += weights[b]
    if len(low) > 2:
        grams = np.zeros((len(low) + 1, weights.shape[1]), np.float32)
        grams[: len(low) - 2] = weights[_trigrams(low)]
        last = np.maximum(ends - 2, starts)
        edges = np.stack([starts, last], axis=1).reshape(-1)
        sums = np.add.reduceat(grams, edges, axis=0)[::2]
        sums[last == starts] = 0  # reduceat gives the element itself for an empty range
        scores += sums
    return scores


def _training_batch(rows: list[list[tuple[bytes, int]]]):
    """rows: parts (text, label), one after the other, of each chain of words."""
    parts = [(t + b" ", y) for row in rows for t, y in row]
    data = np.frombuffer(b"".join(t for t, _ in parts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t, _ in parts])]).astype(np.int64)
    low = _lowered(data)
    starts, ends, first = letter_words(data, offs)
    counts = np.diff(first)
    token, bucket = [], []
    for b in _affixes(low, starts, ends):
        token.append(np.arange(len(starts)))
        bucket.append(b)
    at = np.concatenate([np.arange(s, e - 2) for s, e in zip(starts, ends, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
    bucket.append(_trigrams(low)[at] if len(at) else at)
    token.append(np.repeat(np.arange(len(starts)), np.maximum(ends - starts - 2, 0)))
    token, bucket = np.concatenate(token), np.concatenate(bucket)
    whole = np.add.reduceat(counts, np.cumsum([0, *map(len, rows)])[:-1])
    return (token, bucket, np.ones(len(token))), np.repeat(np.array([y for _, y in parts]), counts), *chains(whole, CHAIN)


def switched(docs: list[tuple[bytes, int]], rng: np.random.Generator) -> list[tuple[bytes, int]]:
    """One chain of runs of 2 to 15 words, each from another document."""
    cut = [(t.split(), y) for t, y in docs]
    out = []
    for k in rng.integers(len(cut), size=int(rng.integers(3, 10))):
        words, y = cut[int(k)]
        if words:
            at, n = int(rng.integers(len(words))), int(rng.integers(2, 16))
            out.append((b" ".join(words[at : at + n]), y))
    return out or [docs[0]]


def fit_languages(labelled: DataFrame, sample: int = SAMPLE, epochs: int = 2, seed: int = 3) -> Crf | None:
    """A model from text and lang of a bounded sample of ``labelled``: whole documents, and
    as many chains that switch between the languages of several."""
    key = F.struct(F.xxhash64("doc_id").alias("at"), F.xxhash64("text", "lang").alias("tie"))
    rows = labelled.select("text", "lang", key.alias("key")).filter(F.col("lang").isNotNull() & F.length("text").between(1, SAMPLE_CHARS))
    last = rows.select("key").orderBy("key").limit(sample).agg(F.max("key")).first()[0]
    # Rows of one key are alike, so it doesn't matter which of them the limit leaves.
    rows = [] if last is None else sorted(rows.filter(F.col("key") <= F.struct(*[F.lit(x).cast("long") for x in last])).limit(2 * sample).collect(), key=lambda r: (r["key"], r["text"], r["lang"]))[:sample]
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return None
    number = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    batches = []
    for i in range(0, len(rows), 25):
        part = [(r["text"].encode("utf-8", "surrogatepass"), number[r["lang"]]) for r in rows[i : i + 25]]
        batch = _training_batch([[x] for x in part] + [switched(part, rng) for _ in part])
        if len(batch[1]):
            batches.append(batch)
    return fit(labels, batches, BUCKETS, epochs)


def _pieces(data: np.ndarray, offs: np.ndarray):
    """(first row, bytes, offsets) with at most PIECE bytes each; a longer row goes in
    pieces cut between words where that is possible."""
    for i, j in tc.slices(offs, PIECE):
        a, b = int(offs[i]), int(offs[j])
        if b - a <= PIECE:
            yield i, data[a:b], offs[i : j + 1] - a
            continue
        while a < b:
            e = min(a + PIECE, b)
            if e < b:
                gap = np.flatnonzero(~_LETTER[data[a:e]])
                e = a + int(gap[-1]) + 1 if len(gap) else e
            yield i, data[a:e], np.array([0, e - a])
            a = e


def judge(column: pa.Array, model: Crf | None) -> tuple[list[str], list[float], np.ndarray, np.ndarray]:
    """Languages, scores, letter words and language switches of a column of texts."""
    data, offs = tc.utf8(column)
    n = len(column)
    k = len(model.labels) if model else 1
    mass, words, switches = np.zeros((n, k)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    plain = np.zeros(n, bool)
    for i, piece, o in _pieces(data, offs):
        starts, ends, first = letter_words(piece, o)
        counts = np.diff(first)
        row = i + np.repeat(np.arange(len(counts)), counts)
        words[i : i + len(counts)] += counts
        ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[piece] & (piece < 128))])
        plain[i : i + len(counts)] |= ascii_letters[o[1:]] > ascii_letters[o[:-1]]
        if model is None or not len(starts):
            continue
        scores = word_scores(_lowered(piece), starts, ends, model.weights).astype(np.float64)
        post = forward_backward(scores, *chains(counts, CHAIN), model.trans)
        for c in range(k):
            mass[:, c] += np.bincount(row, post[:, c], n)
        best = post.argmax(axis=1)
        change = (best[1:] != best[:-1]) & (row[1:] == row[:-1])
        switches += np.bincount(row[1:][change], minlength=n)
    preds, scores_ = [], []
    for r in range(n):
        known = bool(model) and words[r] > 0
        if known and not plain[r]:
            known = any(ch.isalpha() for ch in (column[r].as_py() or ""))
        c = int(mass[r].argmax()) if known else 0
        preds.append(model.labels[c] if known else "und")
        scores_.append(float(min(1.0, mass[r, c] / words[r])) if known else 0.0)
    return preds, scores_, words, switches


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_letter_words long, n_switches long"


def predict_languages(docs: DataFrame, model: Crf | None) -> DataFrame:
    """Language, score, words and language switches of every row of (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            preds, scores, words, switches = judge(b.column(2), model)
            cols = [b.column(0), b.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(words), pa.array(switches)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score", "n_letter_words", "n_switches"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("held_out").cast("boolean").alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def keep_known_languages(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or scores less than ``least``."""
    model = fit_languages(docs.filter(~held_out()))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            preds, scores, _, _ = judge(b.column(at), model)
            yield b.filter(pa.array([p != "und" and s >= least for p, s in zip(preds, scores, strict=True)], pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def held_out():
    """Whether crc32 of the doc_id as text leaves 2 after division by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """A model of the documents that aren't held out, applied to all."""
    marked = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit_languages(marked.filter(~F.col("held_out")))
    return predict_languages(marked.select("doc_id", "held_out", "text"), model)
