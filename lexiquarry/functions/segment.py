"""Stuck words, split by what words a corpus has.

Word counts of a corpus, the ``most`` frequent of those seen ``least`` times, form a trie. A run
of letters that is no known word is split where the product of its parts' shares is largest,
by dynamic programming over the places where known words end; it is split only if that
product exceeds what an unknown word of its length is worth. Parts keep their letters' case;
all else in a text stays as it is. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the model at most, and how often a word must be seen.
MOST = 100_000
LEAST = 5
#: What a letter of an unknown word costs (natural logarithm), and the word itself.
LETTER = math.log(20)
WORD = 6.0
_RUN = re.compile(r"[^\W\d_]+")
_END = "\n"


def word_counts(docs: DataFrame, text: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(word, n): lower-cased runs of letters, the most frequent ones; ties go by word."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)


class Segmenter:
    """A trie of words with their costs."""

    def __init__(self, counts: dict[str, int]) -> None:
        total = sum(counts.values())
        self.root: dict = {}
        for word, n in counts.items():
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[_END] = math.log(total / n)
        self.known = frozenset(counts)

    def split(self, word: str) -> list[str]:
        """The parts of a run of letters; itself, if it is known or no split is worth it."""
        low = word.lower()
        if low in self.known or len(low) != len(word):
            return [word]
        n = len(low)
        cost, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            if cost[i] < math.inf:
                node = self.root
                for j in range(i, n):
                    node = node.get(low[j])
                    if node is None:
                        break
                    if _END in node and cost[i] + node[_END] < cost[j + 1]:
                        cost[j + 1], back[j + 1] = cost[i] + node[_END], i
        if cost[n] >= WORD + LETTER * n:
            return [word]
        out, at = [], n
        while at:
            out.append(word[back[at] : at])
            at = back[at]
        return out[::-1]

    def text(self, text: str) -> tuple[str, int]:
        """A text with its stuck words apart, and how many runs were split."""
        split, seen = 0, {}

        def apart(m: re.Match) -> str:
            nonlocal split
            run = m.group(0)
            if run not in seen:
                seen[run] = self.split(run)
            split += len(seen[run]) > 1
            return " ".join(seen[run])

        return _RUN.sub(apart, text), split


def with_words_apart(docs: DataFrame, key: str, text: str, counts: DataFrame) -> DataFrame:
    """(key, text, n_split) of docs, by a model of ``counts`` (word, n), which is collected: it
    has ``MOST`` rows at most if it comes from ``word_counts``. Null texts stay null."""
    model = docs.sparkSession.sparkContext.broadcast({r["word"]: r["n"] for r in counts.collect()})
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(model.value)
        for b in batches:
            done = [(None, 0) if t is None else segmenter.text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], [key, "text", "n_split"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, text string, n_split long")
