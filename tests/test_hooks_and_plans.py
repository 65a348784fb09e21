"""Operators whose queries have no SQL, hooks that fail, and plans against brute force."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lexiquarry.operators import chunking, cleaning, hooks, metrics, retrieval
from lexiquarry.operators.documents import heuristic_entailment, is_garbled_table, with_garbled_table
from lexiquarry.streaming import queue


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")


def column(df, name="x"):
    return [r[name] for r in df.orderBy("i").collect()]


def test_syllables_are_split_and_compounds_joined(spark):
    df = texts(spark, "tựtrảvềvịtrí", "thu yền", "plain text", None)
    assert column(df.select("i", cleaning.split_syllables(F.col("s")).alias("x"))) == ["tự trả về vị trí", "thuyền", "plain text", None]


def test_syllables_match_python(spark):
    java = [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", new)) for p, new in cleaning._SYLLABLES]
    rng = np.random.default_rng(2)
    values = ["".join(rng.choice(list("aàbđghkntrvịếộyu "), 30)) for _ in range(50)]
    want = []
    for v in values:
        for _ in range(5):
            for p, new in java:
                v = p.sub(new, v)
        want.append(v)
    out = F.col("s")
    for _ in range(5):
        for step in cleaning._SYLLABLES:
            out = F.regexp_replace(out, *step)
    assert column(texts(spark, *values).select("i", out.alias("x"))) == want


def test_semantic_cache_matches_a_plain_one(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i % 2), i, float(i), rng.normal(size=4).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, seq long, seconds double, vector array<double>").repartition(5)
    got = {r["seq"]: (r["decision"], r["match"]) for r in queue.semantic_cache(df, ttl=40.0, least=0.8, capacity=5).collect()}
    want = {}
    for key in ("0", "1"):
        held = []  # [seq, time, vector]
        for _, seq, t, v in [r for r in rows if r[0] == key]:
            v = np.array(v) / np.linalg.norm(v)
            good = [(float(h[2] @ v), -k) for k, h in enumerate(held) if t - h[1] < 40.0 and h[2] @ v >= 0.8]
            if good:
                h = held[-max(good)[1]]
                h[1] = t
                want[seq] = ("hit", h[0])
                continue
            if len(held) >= 5:
                held.remove(min(held, key=lambda h: h[1]))
            held.append([seq, t, v])
            want[seq] = ("miss", None)
    assert got == want and any(d == "hit" for d, _ in got.values())


def test_limiters():
    client = queue.per_client(2, 1 / 100, 500.0)
    state, said = {}, []
    for t in (0, 1, 2, 110, 1000):
        state, d = client(state, float(t), 1.0)
        said.append(d)
    assert said == ["allow", "allow", "deny", "allow", "allow"] and state["tokens"] == 1.0
    slots, state, said = queue.semaphore(2, 10.0), {}, []
    for t in (0, 1, 2, 11):
        state, d = slots(state, float(t), 1.0)
        said.append(d)
    assert said == ["acquired", "acquired", "full", "acquired"]


def test_failing_hooks(spark):
    df = texts(spark, "a b", "c", "").withColumn("t", F.lit("y"))

    def fail(*_):
        raise RuntimeError("no model")

    assert column(hooks.scored(df, fail, "s", "t"), "probs") == [None] * 3
    assert column(hooks.scored(df, lambda a, b: pd.DataFrame({"e": [0.5] * len(a), "n": [0.4] * len(a), "c": [0.1] * len(a)}), "s", "t"), "probs") == [[0.5, 0.4, 0.1]] * 3
    assert column(hooks.reranked(df, fail, "t", "s"), "rerank") == [0.0] * 3
    assert column(hooks.rewritten(df, fail, "s"), "rewritten") == ["a b", "c", ""]
    assert [r["sub_query"] for r in hooks.planned(df, lambda s: list("pqrs"), "s").filter("i = 0").collect()] == ["p", "q", "r"]
    assert column(hooks.planned(df, fail, "s"), "sub_query") == ["a b", "c", ""]
    assert hooks.sampled(df, fail).count() == 3
    assert [tuple(r)[-3:] for r in hooks.judged(df, fail, "s", "t").collect()] == [(0.5, 0.5, 50.0)] * 3
    e = {r["i"]: r for r in hooks.embedded(df, hooks.hashed_vectors, "s").collect()}
    assert e[0]["sparse"] == {"a": 1, "b": 1} and e[2]["sparse"] == {} and len(e[0]["dense"]) == 16 and e[0]["usage"] == 2


def test_batch_verify_agrees_row_by_row(spark):
    pairs = [("Chiều cao không quá 50 m", "Chiều cao không quá 60 m"), ("được phép xây nhà ở đây", "không được xây nhà ở đây"), ("một hai ba bốn năm", "")]
    whole = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, premise string, hypothesis string").repartition(3)
    together = [tuple(r) for r in heuristic_entailment(whole).select("i", "status", "probs").orderBy("i").collect()]
    alone = [tuple(heuristic_entailment(whole.filter(F.col("i") == i)).select("i", "status", "probs").first()) for i in range(3)]
    assert together == alone and together[0][1] == "rejected_contradiction"


def test_nearest_match_on_a_grid(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 5))
    v[10] = 0
    cache = spark.createDataFrame([(i, "k" if i % 3 else "l", v[i].tolist()) for i in range(300)], "c_id long, filter_key string, c_vec array<double>")
    queries = cache.filter("c_id % 7 = 0").toDF("q_id", "filter_key", "q_vec")
    got = {r["q_id"]: (r["c_id"], round(r["sim"], 9)) for r in retrieval.nearest_match(queries, cache, 0.5).collect()}
    want = {}
    for q in range(0, 300, 7):
        best = max((float(v[q] @ v[c] / (np.linalg.norm(v[q]) * np.linalg.norm(v[c]))), -c) for c in range(300) if c != q and (c % 3 > 0) == (q % 3 > 0) and v[c].any())
        if best[0] >= 0.5:
            want[q] = (-best[1], round(best[0], 9))
    assert got == want


def test_numbers_within_groups_and_wild_gaps(spark):
    rows = spark.createDataFrame([("a" if i % 3 else None, i * i) for i in range(100)], "g string, n long")
    got = {r["n"]: r["k"] for r in metrics.numbered_within(rows, "g", "n", "k", blocks=7).collect()}
    for odd in (True, False):
        mine = sorted(i * i for i in range(100) if (i % 3 > 0) == odd)
        assert [got[x] for x in mine] == list(range(len(mine)))
    gaps = metrics.missing_in_range(spark.createDataFrame([(1, 1), (1, 2), (1, 2_000_000_000), (2, 5), (2, 5), (2, 6)], "k int, n int"), "k", "n").collect()
    assert [tuple(r) for r in gaps] == [(1, 1_999_999_997, 3, 1_999_999_999)]


def test_staged_garbled_table_agrees(spark):
    rng = np.random.default_rng(6)
    pieces = ["X", "-", "a long line of words that goes on and on", "NSNN", "NSTP Vốn NĐT", "<br/>", "<math>", "ŧĖΧŲġş", "ab"]
    values = ["\n".join(rng.choice(pieces, int(rng.integers(1, 30)))) for _ in range(150)] + [("x" * 210 + "\n") * 4, "", None, "abc " * 200 + "\n\n"]
    df = texts(spark, *values)
    plain = column(df.select("i", F.coalesce(is_garbled_table(F.col("s")), F.lit(False)).alias("x")))
    assert column(with_garbled_table(df, "s", "x")) == plain and 10 < sum(plain) < 150


def test_chain_takes_the_first_strategy_that_applies(spark):
    df = texts(spark, "Điều 1. Phạm vi của văn bản này là nhà ở và công trình\nĐiều 2. ngắn", "one line of prose that is long enough to be kept as a chunk\nx", "a\nb", "", None)
    got = {}
    for r in chunking.chain_chunks(df, "i", "s").orderBy("i", "n").collect():
        got.setdefault((r["i"], r["strategy"]), []).append(r["chunk"])
    assert got == {(0, "article"): ["Điều 1. Phạm vi của văn bản này là nhà ở và công trình"], (1, "fallback"): ["one line of prose that is long enough to be kept as a chunk"], (2, "fallback"): ["a", "b"]}
