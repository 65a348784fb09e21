"""Hard negatives against brute force over all rows."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lexiquarry.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    clean = set()
    for i, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = tuple(math.floor(256 * float(np.float32(x))) for x in e)
        if sum(x * x for x in v) < 1 << 53:
            clean.add((i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    place = lambda i: (i is None, i or 0)
    for a, av, al in clean:
        if a is None or a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(av, v, strict=False)), place(i), i, label) for i, v, label in clean if i != a]
        for s, _, p, _ in sorted(x[:3] + (0,) for x in scored if x[3] == al)[:5]:
            fit = sorted(x[:3] for x in scored if x[3] != al and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, _, i) in enumerate(fit)]
    return sorted(out, key=str)


def mined(df):
    got = negatives.mine_hard_negatives(negatives.quantised(df), F.col("vec_id") % 50 == 0)
    return sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str)


def clusters(n, seed, dim=8, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    at = rng.integers(12, size=n)
    v = centres[at] + spread * rng.normal(size=(n, dim))
    v *= rng.uniform(0.2, 1.5, size=(n, 1)) / np.linalg.norm(v, axis=1, keepdims=True)
    return [(int(i), v[i].astype(np.float32).tolist(), int(rng.integers(5))) for i in range(n)]


def test_equals_brute_force_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "GROUP", 7)
    rows = clusters(900, 1)
    same = rows[100][1]
    rows += [(1000 + k, same, 1) for k in range(200)]  # copies, anchors among them
    rows += [(2000 + k, [0.0] * 8, k % 3) for k in range(60)]  # every score is 0
    rows += [(3000, None, 1), (3001, [0.1, None] + [0.0] * 6, 1), (3002, [float("nan")] * 8, 1), (3003, [float("inf")] * 8, 2), (3004, [0.5] * 8, None), (None, same, 1), (None, same, 2)]
    rows += [(3050, [3e38] * 8, 1), (3100, [0.5, 0.5], 2), (3150, [], 3), rows[50], rows[50], rows[100]]
    df = spark.createDataFrame([(*r, "c") for r in rows], SCHEMA + ", v string").repartition(5)
    want = brute(rows)
    assert len(want) > 200
    assert mined(df) == want


def test_equals_sql(spark):
    rows = clusters(600, 3, dim=16)
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({negatives.ORACLE})").fetchall()
    assert mined(df) == sorted(want, key=str)


def test_without_rows_or_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty) == []
    assert mined(spark.createDataFrame([(1, [1.0, 2.0], 3), (2, [1.0, 2.0], 4)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(50, [1.0, 2.0], 3)], SCHEMA)) == []


def test_near_anchors_skip_cells(spark):
    """On rows in clusters the bound rules most cells out."""
    rows = negatives.quantised(spark.createDataFrame(clusters(3000, 4, spread=0.01), SCHEMA)).cache()
    top, width = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.size("v"))).first()
    index, keys = negatives._index(rows, top, width)
    specs = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("sid"), "label", "v", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    got = negatives.search(specs, index, keys, 3, True, width)
    assert got.count() == 3 * 60
    last = {r["sid"]: r["score"] for r in got.filter("nth = 3").collect()}
    open_ = specs.join(spark.createDataFrame([(k, float(v)) for k, v in last.items()], "sid string, bound double"), "sid").withColumn("done", F.lit(1))
    planned = negatives._plan(open_, keys, 3, width)
    asked = planned.select(F.explode("next").alias("n")).agg(F.avg("n")).first()[0]
    assert asked < 0.7 * len(keys.low)
