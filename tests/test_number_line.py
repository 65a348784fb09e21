"""Nearest numbers in a band of groups, against SQL and brute force."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lexiquarry.operators import number_line
from lexiquarry.plans import retrieval

NAN, INF = float("nan"), float("inf")
PART = "p_partkey long, p_size int, p_retailprice double"
SUPPLIER = "s_suppkey long, s_nationkey int, s_acctbal double"


def tables(spark, path, parts, suppliers):
    spark.createDataFrame(parts, PART).write.parquet(f"{path}/part.parquet")
    spark.createDataFrame(suppliers, SUPPLIER).write.parquet(f"{path}/supplier.parquet")
    return str(path)


def plain(rows):
    return sorted(repr(tuple(f"{x:.12g}" if isinstance(x, float) else x for x in r)) for r in rows)


def against_sql(spark, d):
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    got = retrieval.QUERIES["wn21_nearest_label"](spark, d).collect()
    assert plain(got) == plain(con.execute(retrieval.ORACLES["wn21_nearest_label"]).fetchall())
    return len(got)


def made_by_joins(df):
    """Rows that the joins of a plan make, after a run."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if "Join" in name:
            most += p.metrics().apply("numOutputRows").value()
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else []
        todo += inner + [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_odd_numbers_match_sql(spark, tmp_path):
    rng = np.random.default_rng(7)
    odd = [None, 0.0, -0.0, 1e18, 1e306, -1e306]
    price = lambda: odd[rng.integers(len(odd))] if rng.random() < 0.3 else round(float(rng.uniform(-50, 50)), 1)
    parts = [(int(i // 2) if i % 5 == 0 else i, None if i % 50 == 3 else int(rng.integers(0, 14)), price()) for i in range(300)]
    suppliers = [(None if i % 40 == 7 else i, None if i % 30 == 4 else int(rng.integers(0, 10)), price()) for i in range(200)]
    # A group that has nothing but nulls.
    suppliers += [(900, 20, None), (901, 20, None)]
    parts += [(1000, 20, 5.0), (1001, 22, None), (1002, 40, 1.0)]
    assert against_sql(spark, tables(spark, tmp_path, parts, suppliers)) > 200


def test_nan_and_infinite_numbers(spark, tmp_path):
    # DuckDB takes no square root of what it cannot subtract; so by brute force.
    values = [NAN, INF, -INF, None, 1.0, 2.5, 2.5, -4.0]
    marks = [(g, w, 10 * g + i) for g in (0, 1, 5, 9) for i, w in enumerate(values) if g != 9 or w != w]
    points = [(a, v) for a in (0, 3, 8, 30) for v in values]
    got = number_line.nearest_in_band(spark.createDataFrame(points, "a int, v double"), spark.createDataFrame(marks, "b int, w double, key long"), 2)
    order = lambda d: (2, 0.0) if d is None else (1, 0.0) if math.isnan(d) else (0, d)
    want = []
    for a, v in {(a, repr(v)): (a, v) for a, v in points}.values():
        met = [(order(d := None if None in (v, w) else float(a - b) ** 2 + (v - w) ** 2), k, d) for b, w, k in marks if abs(a - b) <= 2]
        if met:
            want.append((a, v, min(met, key=lambda m: m[:2])[2], min(met, key=lambda m: m[:2])[1]))
    assert plain(tuple(r) for r in got.collect()) == plain(want)


def test_ties_by_rounding_go_to_the_least_key(spark, tmp_path):
    # Far from all balances the differences are lost by rounding, so all suppliers are as near.
    parts = [(i, 3 + i % 3, 1e17 + 1e4 * i) for i in range(20)] + [(100, 4, -1e15)]
    suppliers = [((i * 37) % 101 + 1, i % 9, i / 10) for i in range(100)]
    assert against_sql(spark, tables(spark, tmp_path, parts, suppliers)) == 21


def test_pairs_are_not_made(spark, tmp_path):
    parts = [(i, 2 + i % 3, i / 7) for i in range(3000)]
    suppliers = [(i, i % 6, i * 0.13) for i in range(3000)]
    d = tables(spark, tmp_path, parts, suppliers)
    assert against_sql(spark, d) == 3000
    # Each of these parts has five nations of 500 suppliers.
    assert made_by_joins(retrieval.QUERIES["wn21_nearest_label"](spark, d)) < 100_000


def test_marks_beyond_the_block(spark):
    marks = spark.createDataFrame([(g, float(x), x) for g, x in ((1, 0), (1, 1), (1, 1000), (1, 1001), (2, 500))], "g int, x double, key long")
    points = spark.range(1, 1000).select(F.explode(F.array(*[F.lit(g) for g in (1, 2, 3)])).alias("g"), (F.col("id") + 0.5).alias("x"))
    got = {(r["g"], r["x"]): tuple((s["key"], s["behind"]) if s else None for s in (r["below"], r["above"])) for r in number_line.neighbours(points, marks).collect()}
    assert len(got) == 3 * 999
    for (g, x), sides in got.items():
        assert sides == {1: ((1, 0.0), (1000, 1001.0)), 2: ((500, None) if x > 500 else None, (500, None) if x < 500 else None), 3: (None, None)}[g]
