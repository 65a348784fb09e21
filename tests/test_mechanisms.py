"""Recursion, interval joins, upserts and streams with late rows."""

import datetime as dt
import os

import numpy as np
from pyspark.sql import functions as F

from lexiquarry.operators import documents, graph, legal
from lexiquarry.operators.intervals import interval_join
from lexiquarry.operators.rules import edition_at
from lexiquarry.sources.keyed_store import KeyedStore
from lexiquarry.streaming import windows as win


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reach_in_a_cyclic_graph_to_depth_ten(spark):
    rng = np.random.default_rng(1)
    edges = {(int(a), int(b)) for a, b in rng.integers(120, size=(160, 2))} | {(3, 4), (4, 3), (5, 5)}
    df = spark.createDataFrame([(a, "R", b) for a, b in edges], "src long, rel string, dst long")
    starts = spark.createDataFrame([(3,), (5,), (999,), (3,)], "id long")
    want = set()
    for s in (3, 5, 999):
        depth, ring = {s: 0}, {s}
        for k in range(1, 11):
            ring = {b for a, b in edges if a in ring} - set(depth)
            depth |= dict.fromkeys(ring, k)
        want |= {(s, i, k) for i, k in depth.items()}
    assert {tuple(r) for r in graph.reachable(df, starts, 10).collect()} == want
    short, long = (len(plan(graph.reachable(df, starts, n))) for n in (2, 10))
    assert long < 1.5 * short


def test_longest_chain_visits_no_node_twice(spark):
    edges = [(1, "A", 2), (2, "B", 3), (3, "C", 1), (1, "D", 3), (3, "E", 4), (2, "F", 4), (7, "G", 7)] + [(100 + k, "N", 101 + k) for k in range(30)]
    df = spark.createDataFrame(edges, "src long, rel string, dst long")
    starts = spark.createDataFrame([(1,), (7,), (100,)], "id long")
    got = {r["start"]: (r["path"], r["rels"]) for r in graph.longest_chain(df, starts, 10).collect()}
    assert got == {1: ([1, 2, 3, 4], ["A", "B", "E"]), 7: ([7], []), 100: (list(range(100, 111)), ["N"] * 10)}
    short, long = (len(plan(graph.longest_chain(df, starts, n))) for n in (2, 30))
    assert abs(long - short) < 20


def test_timeline_has_all_sections_in_order(spark):
    nodes = spark.createDataFrame([(i, f"n{i}" if i != 4 else None, "2020-01-01" if i == 1 else None, "DRAFT" if i == 2 else None) for i in range(1, 12)], "id long, number string, effective_date string, status string")
    none = (None, None, None)
    edges = [(2, "REPLACES", 1, *none), (3, "PROMULGATES", 1, *none), (4, "AMENDS", 1, *none), (1, "AMENDS", 5, *none), (1, "REPLACES", 6, *none), (6, "REFERENCES", 7, *none), (1, "REFERENCES", 8, *none), (9, "GOVERNS_TRANSITIONAL", 1, "c", "g", "if"), (1, "GOVERNS_TRANSITIONAL", 10, "c2", None, None), (1, "AMENDS", 5, *none)]
    e = spark.createDataFrame(edges, "src long, rel string, dst long, cutoff_date string, grace_period_end string, condition string")
    got = graph.timeline(nodes, e, spark.createDataFrame([(1,), (11,), (77,)], "id long")).orderBy("start", "section", "ord").collect()
    first = [(r["section"], r["id"], r["number"], r["status"], r["relation_to_next"], r["cutoff_date"]) for r in got if r["start"] == 1]
    assert first == [
        (1, 2, "n2", "DRAFT", "REPLACES", None),
        (2, 3, "n3", "ACTIVE", "PROMULGATES", None),
        (3, 4, "4", "ACTIVE", "AMENDS", None),
        (4, 1, "n1", "UNKNOWN", "AMENDS", None),
        (6, 5, "n5", "ACTIVE", None, None),
        (7, 6, "n6", "OUTDATED", "REFERENCES", None),
        (7, 7, "n7", "OUTDATED", None, None),
        (8, 9, "n9", "ACTIVE", "GOVERNS_TRANSITIONAL", "c"),
        (9, 10, "n10", "OUTDATED", "TRANSITIONAL_PREDECESSOR", "c2"),
    ]
    assert [(r["section"], r["relation_to_next"], r["effective_date"]) for r in got if r["start"] == 11] == [(4, None, "unknown")]
    assert {r["start"] for r in got} == {1, 11}


def test_intervals_of_all_lengths(spark):
    rng = np.random.default_rng(2)
    points = [(i, float(rng.integers(-1000, 1000)) / 4, int(rng.integers(3)) if i % 20 else None) for i in range(500)] + [(900, None, 1)]
    spans = []
    for j in range(200):
        lo = float(rng.integers(-1200, 1200)) / 4
        hi = lo + [0.0, 0.25, 1.0, 7.5, 64.0, 500.0, -3.0][j % 7]
        spans.append((j, None if j % 13 == 0 else lo, None if j % 17 == 0 else hi, j % 3))
    p = spark.createDataFrame(points, "i long, at double, k int")
    s = spark.createDataFrame(spans, "j long, lo double, hi double, k int")
    want = {(i, j) for i, at, k in points for j, lo, hi, m in spans if at is not None and k == m and (lo is None or lo <= at) and (hi is None or at < hi)}
    got = interval_join(p, "at", s, "lo", "hi", ("k",))
    rows = [(r["i"], r["j"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 1000
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert interval_join(p.limit(0), "at", s, "lo", "hi").count() == 0


def test_editions_by_date(spark):
    days = [(i, dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(30)]
    e = spark.createDataFrame([("a", None, dt.date(2020, 1, 5)), ("b", dt.date(2020, 1, 5), dt.date(2020, 1, 20)), ("c", dt.date(2020, 1, 25), None)], "edition string, valid_from date, valid_to date")
    got = {r["i"]: r["edition"] for r in edition_at(spark.createDataFrame(days, "i long, day date"), "i", "day", e).collect()}
    assert got == {i: "a" if i < 4 else "b" if i < 19 else None if i < 24 else "c" for i in range(30)}


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_an_upsert_writes_the_folders_of_its_keys_and_a_second_one_nothing(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), "id", "id long, status string, note string", folders=8)
    store.create(spark.createDataFrame([(i, "A", f"n{i}") for i in range(100)], "id long, status string, note string"))
    before = files(tmp_path / "rows")
    new = spark.createDataFrame([(7, "B"), (7, "C"), (200, "B")], "id long, status string")
    rule = {"status": F.col("new.status")}
    written = store.upsert(new, rule)
    assert 1 <= len(written) <= 2
    after = files(tmp_path / "rows")
    kept = {f for f in before if f in after}
    assert all(before[f] == after[f] for f in kept) and {f.split("folder=")[1].split("/")[0] for f in before if f not in kept} <= {str(w) for w in written}
    rows = {r["id"]: (r["status"], r["note"]) for r in store.read().collect()}
    assert rows == {i: ("A", f"n{i}") for i in range(100)} | {7: ("B", "n7"), 200: ("B", None)}
    assert store.upsert(new, rule) == [] and files(tmp_path / "rows") == after


def test_claims(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), "file", "file string, status string, retries int, owner string, claimed_at double", folders=4)
    store.create(spark.createDataFrame([("p", "PENDING", 0, None, None), ("f2", "FAILED", 2, None, None), ("f3", "FAILED", 3, None, None), ("old", "CLAIMED", 0, "x", 0.0), ("fresh", "CLAIMED", 0, "x", 950.0), ("done", "COMPLETED", 0, None, None)], store.schema))
    for worker, now in (("w1", 1000.0), ("w2", 1001.0), ("w1", 1000.0)):
        documents.claim(store, spark.createDataFrame([(f, worker, now) for f in ("p", "f2", "f3", "old", "fresh", "done", "new")], "file string, owner string, claimed_at double"))
    got = {r["file"]: (r["status"], r["owner"]) for r in store.read().collect()}
    assert got == {"p": ("CLAIMED", "w1"), "f2": ("CLAIMED", "w1"), "f3": ("FAILED", None), "old": ("CLAIMED", "w1"), "fresh": ("CLAIMED", "x"), "done": ("COMPLETED", None), "new": ("CLAIMED", "w1")}


def test_versions(spark, tmp_path):
    status = KeyedStore(spark, str(tmp_path / "s"), "id", "id long, status string")
    edges = KeyedStore(spark, str(tmp_path / "e"), "key", "key string, src long, rel string, dst long")
    status.create(spark.createDataFrame([(1, "ACTIVE"), (2, "ACTIVE"), (3, "ACTIVE")], status.schema))
    edges.create(spark.createDataFrame([], edges.schema))
    told = spark.createDataFrame([(9, 1, 2), (8, None, 1)], "new long, supersedes long, amends long")
    for _ in range(2):
        legal.version_update(status, edges, told)
    assert {tuple(r) for r in status.read().collect()} == {(1, "SUPERSEDED"), (2, "OUTDATED"), (3, "ACTIVE")}
    assert {tuple(r)[1:] for r in edges.read().collect()} == {(9, "SUPERSEDES", 1), (9, "AMENDS", 2), (8, "AMENDS", 1)}


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def streamed(spark, path, batches):
    for rows in batches:
        spark.createDataFrame([(at(m), kind) for m, kind in rows], "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(path)


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    batches = [[(1, "error"), (2, "ok"), (11, "ok")], [(3, "error"), (25, "error"), (26, "ok")], [(18, "ok"), (50, "ok")], [(4, "error"), (19, "ok")], [(500, "ok")]]
    s = streamed(spark, str(tmp_path / "in"), batches)
    got = win.drain(win.rates(s, "ts", "10 minutes", "10 minutes", F.col("kind") == "error"), str(tmp_path / "out"))
    # The second file puts the watermark at 16 and the third tells the window of minute 4; that of minute 19 is still open.
    want = {at(0): (2, 3), at(10): (0, 3), at(20): (1, 2), at(50): (0, 1)}
    assert {r["start"]: (r["bad"], r["n"]) for r in got.collect()} == want


def test_conjunctive_alert_needs_both_series_and_windows_in_a_row(spark, tmp_path):
    bad, ok = "error", "ok"
    rows = [(5, bad), (6, ok), (15, bad), (16, ok), (25, bad), (45, bad), (46, ok), (55, ok), (65, bad), (66, ok), (75, bad), (76, ok)]
    s = streamed(spark, str(tmp_path / "in"), [rows[:5], rows[5:], [(1000, ok)]])
    errors = win.counted(s, "ts", "1 minute", "10 minutes", F.lit(True), where=F.col("kind") == "error").select("w", "bad")
    fine = win.counted(s, "ts", "1 minute", "10 minutes", F.lit(True), where=F.col("kind") == "ok").select("w", "n")
    got = win.drain(win.sustained(win.conjunction(errors, fine), F.col("bad") >= 1, "10 minutes", 2), str(tmp_path / "out"))
    assert {r["end"] for r in got.collect()} == {at(20), at(80)}


def test_stuck_words_are_split_as_the_best_of_all_splits():
    import itertools
    import math

    from lexiquarry.functions.segment import LETTER, WORD, Segmenter

    counts = {"the": 50, "a": 40, "an": 20, "cat": 9, "at": 30, "he": 12, "car": 8, "art": 7, "tea": 6, "earth": 5, "hearth": 2}
    s, total = Segmenter(counts), sum(counts.values())
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list(counts), int(rng.integers(1, 4)))) for _ in range(300)] + ["".join(rng.choice(list("theacr"), 7)) for _ in range(300)]
    for w in words:
        best = (WORD + LETTER * len(w), [w])
        for cuts in itertools.product((False, True), repeat=len(w) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(w)]
            parts = [w[a:b] for a, b in itertools.pairwise(at)]
            if all(p in counts for p in parts):
                best = min(best, (sum(math.log(total / counts[p]) for p in parts), parts), key=lambda x: x[0])
        got = s.split(w)
        if w in counts:
            assert got == [w]
        else:
            value = lambda ps: WORD + LETTER * len(w) if ps == [w] else sum(math.log(total / counts[p]) for p in ps)
            assert "".join(got) == w and abs(value(got) - best[0]) < 1e-9
    assert s.text("TheCat, thecat 7thecat\n") == ("The Cat, the cat 7the cat\n", 3)


def test_learned_splits_over_texts(spark):
    from lexiquarry.functions import segment

    df = spark.createDataFrame([(1, "green house stands near green river " * 10), (2, None), (3, "greenriver Nearhouse x9 greenish"), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_split"]) for r in segment.with_words_apart(df, "doc_id", "text", segment.word_counts(df, "text")).collect()}
    assert got[3] == ("green river Near house x9 greenish", 2) and got[2] == (None, 0) and got[4] == ("", 0) and got[1][1] == 0


def test_the_table_function_equals_the_chain(spark):
    import pytest

    from lexiquarry.operators import chunk_udtf, chunking

    rng = np.random.default_rng(6)
    bits = ["Điều 1. Phạm vi điều chỉnh của quy định này là nhà ở", "\n", "\n\n", "1.2 some numbered part that is long enough to be kept", "Chương II quy định chung", "Name: some one", "x", "  spaced line of prose that goes on for a while  ", "Điều 22: short"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 9)))) for _ in range(150)] + ["", None, "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chunk_udtf.register(spark)
    got = spark.sql("SELECT doc_id, c.strategy, c.n, c.chunk FROM {docs}, LATERAL chunk_text(text) c", docs=df)
    want = chunking.chain_chunks(df, "doc_id", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("doc_id", "strategy", "n", "chunk").collect()))
    lines = spark.sql("SELECT c.* FROM chunk_text('a\nb', 'article,fallback', 1) c").collect()
    assert [tuple(r) for r in lines] == [("fallback", 0, "a"), ("fallback", 1, "b")]
    with pytest.raises(Exception, match="no such strategy"):
        spark.sql("SELECT c.* FROM chunk_text('a', 'nonsense') c").collect()


def test_metrics_come_with_the_write(spark, tmp_path):
    from lexiquarry.sources.writers import write_observed

    rows = spark.range(100).withColumn("odd", F.col("id") % 2 == 1)
    got = write_observed(rows, lambda x: x.write.parquet(f"{tmp_path}/q"), depth=F.count("*"), odd=F.count_if("odd"))
    assert got == {"depth": 100, "odd": 50} and spark.read.parquet(f"{tmp_path}/q").count() == 100


def test_phrases_in_several_passes(spark, monkeypatch):
    from lexiquarry.operators import phrases

    docs = spark.createDataFrame([(1, "The cat sat. A DOG"), (2, None), (3, "dogcat"), (4, "")], "k long, text string")
    asked = spark.createDataFrame([(1, "Cat", False), (2, "dog", False), (3, "cat sat", True), (4, "", False), (5, "cat", True)], "id long, phrase string, is_banned boolean")
    want = {1: [1, 2, 3, 5], 2: [], 3: [1, 2, 5], 4: []}
    for most in (4 << 20, 4):
        monkeypatch.setattr(phrases, "MOST", most)
        assert {r["k"]: r["ids"] for r in phrases.phrase_hits(docs, "k", "text", asked).collect()} == want
    got = {r["k"]: (r["hits"], r["misses"], r["banned"], r["score"]) for r in phrases.phrase_scores(docs, "k", "text", asked.filter("id != 4")).collect()}
    assert got[1] == ([1, 2], [], [3, 5], 80.0) and got[2] == ([], [1, 2], [], 0.0)


def test_best_covered(spark):
    from lexiquarry.operators.metrics import best_covered

    items = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, []), (3, ["z"])], "item long, bw array<string>")
    docs = spark.createDataFrame([(10, ["a", "b"]), (11, ["a", "c", "d"]), (12, ["b", "a"]), (13, ["q"])], "doc long, dw array<string>")
    got = sorted(map(tuple, best_covered(items, docs, "item", "doc", 2).collect()))
    assert got == [(1, 10, 0.5, 2), (1, 11, 0.75, 1), (2, 10, 1.0, 1), (2, 11, 1.0, 2)]


def test_files_by_the_data_source(spark, tmp_path):
    import json

    from lexiquarry.sources import corpus_source

    for folder, slug, meta, body in (("laws", "b", {"id": "x", "status": "Expired", "replaces": ["q", "p", "p"], "title": "T"}, "# text"), ("laws", "a", None, None), ("codes", "c", {"document_number": "7", "amends": "z"}, None)):
        at = tmp_path / "bundles" / folder / slug
        at.mkdir(parents=True)
        if meta is not None:
            (at / "metadata.json").write_text(json.dumps(meta))
        else:
            (at / "metadata.json").write_text("no json")
        if body:
            (at / "index.md").write_text(body)
    corpus_source.register(spark)
    rows = spark.read.format("corpus_files").option("kind", "bundle").load(str(tmp_path / "bundles"))
    got = [tuple(r) for r in rows.orderBy("slug").collect()]
    assert got == [
        ("laws", "a", None, "a", "a", "unknown", "ACTIVE", [], [], None),
        ("laws", "b", "x", "b", "T", "unknown", "OUTDATED", ["p", "q"], [], "# text"),
        ("codes", "c", None, "7", "c", "unknown", "ACTIVE", [], ["z"], None),
    ]
    some = rows.filter("folder = 'laws' AND status = 'OUTDATED' AND length(title) < 5")
    assert [r["slug"] for r in some.collect()] == ["b"]
    reader = corpus_source.CorpusReader("bundle", str(tmp_path / "bundles"), 10)
    left = list(reader.pushFilters([corpus_source.EqualTo(("folder",), "laws"), corpus_source.EqualTo(("folder",), "codes")]))
    assert len(left) == 1 and [p.paths for p in reader.partitions()] == [[f"{tmp_path}/bundles/laws/a/metadata.json", f"{tmp_path}/bundles/laws/b/metadata.json"]]
    text = plan(some)
    assert "folder" not in text.split("BatchScan")[0] or "Filter" not in text.split("folder")[0], text
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "one.json").write_text(json.dumps({"doc_id": 5, "chunks": [{"text": "abcdefghijkl", "page": 3}, {"chunk_type": "child"}]}))
    (tmp_path / "e" / "bad.json").write_text("{")
    rows = spark.read.format("corpus_files").option("kind", "export").option("most", "4").load(str(tmp_path / "e"))
    assert sorted(tuple(r)[2:8] for r in rows.collect()) == [("5", "unknown", 0, "abcd", 3, "parent"), ("5", "unknown", 1, None, 1, "child")]
