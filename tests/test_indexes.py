"""The inverted index and the vector index against all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import inverted_index, retrieval, vector_index


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    """Documents in which words are as unequal as in prose, one word in all of them."""
    rng = np.random.default_rng(1)
    rows = [(k, f"w{min(int(z), 400)}", int(1 + rng.integers(1 + 60 // min(int(z), 60)))) for k in range(3000) for z in set(rng.zipf(1.5, 12).tolist())]
    rows += [(k, "all", 1 + k % 3) for k in range(3000)]
    df = spark.createDataFrame(rows, "key long, term string, weight long")
    path = str(tmp_path_factory.mktemp("index"))
    return df, inverted_index.build(df, path, parts=4, block=32)


def queries(spark):
    return spark.createDataFrame([(1, "all", 1), (1, "w7", 2), (2, "w1", 3), (2, "w2", 1), (2, "w90", 5), (3, "nowhere", 1), (4, "w301", 1), (5, "w1", 1)], "qid long, term string, weight long")


def test_searches_are_exact_and_ties_go_by_key(spark, words):
    df, index = words
    postings = {}
    for r in df.collect():
        postings.setdefault(r["term"], []).append((r["key"], r["weight"]))
    for k in (1, 10, 200, 5000):
        want = []
        for q in range(1, 6):
            scores = {}
            for r in queries(spark).filter(F.col("qid") == q).collect():
                for key, w in postings.get(r["term"], []):
                    scores[key] = scores.get(key, 0) + w * r["weight"]
            best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
            want += [(q, key, float(s), n + 1) for n, (key, s) in enumerate(best)]
        got = inverted_index.search(index, queries(spark), k)
        assert sorted(map(tuple, got.select("qid", "key", "score", "rank").collect()), key=lambda r: (r[0], r[3])) == want


def test_most_postings_are_skipped(spark, words):
    _, index = words
    read = {r["qid"]: (r["postings"], r["read"]) for r in inverted_index.postings_read(index, queries(spark), 10).collect()}
    assert 3 not in read and read[2][1] < 0.5 * read[2][0] and read[5][1] < 0.2 * read[5][0]
    blocks = index.table("blocks")
    assert blocks.agg(F.max("n")).first()[0] == 32 and blocks.filter("term = 'all'").count() >= 3000 / 32
    falling = blocks.select(F.expr("forall(sequence(2, size(entries)), i -> size(entries) < 2 OR entries[i - 1].weight <= entries[i - 2].weight)").alias("ok"), (F.col("entries")[0]["weight"] == F.col("top")).alias("top"))
    assert falling.filter("NOT top OR (NOT ok AND size(array(ok)) > 1)").count() == 0


def test_an_empty_table(spark, tmp_path):
    index = inverted_index.build(spark.createDataFrame([], "key long, term string, weight long"), str(tmp_path / "i"))
    assert index.table("heads").count() == 0
    assert inverted_index.search(index, queries(spark), 3).count() == 0


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_TOGETHER", 7)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8))
    v[50] = v[60] = v[70]
    v[5] = 0
    rows = spark.createDataFrame([(i, i % 3 if i % 11 else None, v[i].tolist()) for i in range(400)], "c_id long, filter_key int, c_vec array<double>")
    asked = rows.filter("c_id % 10 = 0").select(F.col("c_id").alias("q_id"), "filter_key", F.col("c_vec").alias("q_vec"))
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    want = []
    for q in range(0, 400, 10):
        if q % 11 == 0:
            continue
        sims = [(-round(float(unit[q] @ unit[c]), 9), c) for c in range(400) if c % 11 and c % 3 == q % 3 and c != q]
        want += [(q, c, -s, n + 1) for n, (s, c) in enumerate(sorted(x for x in sims if -x[0] >= 0.1)[:4])]
    got = sorted(map(tuple, retrieval.nearest(asked, rows, 4, 0.1).select("q_id", "c_id", "sim", "rank").collect()), key=lambda r: (r[0], r[3]))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-9)


def recall(spark, path, v, k=10):
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    vector_index.build(rows, path)
    index = vector_index.load(spark, path)
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("q_id"), "v")
    got = {}
    for r in vector_index.search(index, asked, k).collect():
        got.setdefault(r["q_id"], set()).add(r["id"])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    exact = {q: set(np.argsort(-sims[q])[:k].tolist()) for q in range(0, len(v), 20)}
    return sum(len(got[q] & exact[q]) for q in exact) / (k * len(exact)), index


def test_approximate_search_finds_nearly_all(spark, tmp_path):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(40, 64))[rng.integers(40, size=3000)] + 0.6 * rng.normal(size=(3000, 64))
    share, index = recall(spark, str(tmp_path / "a"), mixed)
    assert share >= 0.95
    assert index.table("codes").select(F.explode("codes").alias("c")).filter("length(c) != 16").count() == 0
    share, _ = recall(spark, str(tmp_path / "b"), rng.normal(size=(1500, 64)))
    assert share >= 0.95


def test_vectors_without_length_are_in_no_answer(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.1]), (5, [float("nan"), 1.0])], "id long, v array<double>")
    vector_index.build(rows, str(tmp_path / "i"), cells=2, parts=2)
    index = vector_index.load(spark, str(tmp_path / "i"))
    got = vector_index.search(index, rows.select(F.col("id").alias("q_id"), "v"), 5).collect()
    assert sorted((r["q_id"], r["id"]) for r in got) == [(1, 4), (4, 1)]
