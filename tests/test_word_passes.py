"""Replacements inside distinct words, against the same patterns over whole texts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexiquarry.functions import word_passes
from lexiquarry.operators import cleaning
from lexiquarry.plans import cleaning as plans


def by_patterns(text):
    steps = [word_passes.python_step(*p) for p in cleaning._SYLLABLES]
    for _ in range(5):
        for p, new in steps:
            text = p.sub(new, text)
    for p, new in (word_passes.python_step(*p) for p in cleaning._UY):
        text = p.sub(new, text)
    return text


def odd_texts():
    rng = np.random.default_rng(11)
    letters = list("aàbđghkntrvịếộyu")
    pieces = ["thu yền", "NGU  Yên", "quy\nết", "huy ếp", "tuyền", "êu", "Être", "-thu yện,", "_thu yền", "thu yềna", "  ", " ", "\n", "\t", "u", "y", "uy", "ế", "ang", "anthing", "à", "|"]
    for _ in range(150):
        yield "".join(rng.choice(letters + [" ", "\n"], int(rng.integers(0, 60))))
    for _ in range(400):
        parts = [rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choice(letters, 5)) for _ in range(int(rng.integers(1, 9)))]
        yield rng.choice(["", " "]).join(parts)
    yield from ("", " ", "  anthing", "anthing  ", "à" * 3, "àbà" * 50, "trvị" * 200, "𝒳àgà 😀 thu yền")


def test_syllables_equal_patterns_over_whole_texts(spark, monkeypatch):
    values = [None, *odd_texts(), None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string").repartition(3)
    got = {r["i"]: r["x"] for r in df.select("i", cleaning.split_syllables(F.col("s")).alias("x")).collect()}
    want = {i: v if v is None else by_patterns(v) for i, v in enumerate(values)}
    assert {i: (values[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert sum(v is not None and want[i] != v for i, v in enumerate(values)) > 300


def test_each_distinct_word_is_searched_once():
    seen = []

    def change(words):
        seen.extend(words.split("  "))
        return words.replace("ab", "a b")

    texts = pa.array(["ab cd  xab", "", "cd\n", " ab ", *["xab ab ab"] * 1000])
    assert word_passes.in_words(texts, "ab", change).to_pylist() == ["a b cd  xa b", "", "cd\n", " a b ", *["xa b a b a b"] * 1000]
    assert sorted(seen) == ["ab", "xab"]
    assert word_passes.in_words(pa.array([], pa.string()), "ab", change).to_pylist() == []


def test_slices_bound_the_bytes_at_once(monkeypatch):
    monkeypatch.setattr(word_passes, "AT_ONCE", 10)
    texts = pa.array(["x" * n if n else None for n in (3, 7, 1, 0, 30, 0, 10, 2)]).slice(1)
    parts = [p.to_pylist() for p in word_passes.slices(texts)]
    assert [x for p in parts for x in p] == texts.to_pylist() and all(len(p) == 1 or sum(len(x or "") for x in p) <= 10 for p in parts)
    assert [p.to_pylist() for p in word_passes.slices(pa.array([], pa.string()))] == [[]]


def test_no_pattern_runs_over_whole_texts(spark):
    # It was 22 patterns over every text.
    df = plans.QUERIES["tx9_syllable_boundaries"](spark, "/root/testdata/sf0.001")
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()
