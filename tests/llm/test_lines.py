import numpy as np

from lexiquarry.llm import lines as ln


def brute(rows):
    seen, out = [], {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        gone = []
        for no, line in enumerate((text or "").split("\n")):
            s = frozenset(line.split())
            if not s:
                continue
            if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone.append(no)
            seen.append(s)
        out[doc_id] = ((text or "").count("\n") + 1, len(gone), ",".join(map(str, gone)))
    return out


def corpus(seed, docs=60):
    rng = np.random.default_rng(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}é" for i in range(800)]
    pool = [list(rng.choice(rare, int(rng.integers(1, 30)))) + list(rng.choice(common, 3)) for _ in range(40)]
    texts = []
    for _ in range(docs):
        lines = []
        for _ in range(int(rng.integers(0, 8))):
            k = rng.random()
            if k < 0.45:
                line = list(pool[int(rng.integers(len(pool)))])
                for _ in range(int(rng.integers(0, 5))):
                    line[int(rng.integers(len(line)))] = str(rng.choice(rare))
                rng.shuffle(line)
            elif k < 0.6:
                line = list(rng.choice(common, int(rng.integers(1, 7))))
            else:
                line = list(rng.choice(rare, int(rng.integers(0, 25))))
            lines.append("  ".join(line) + (" \r" if k < 0.1 else ""))
        texts.append("\n".join(lines))
    return texts


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = [(int(i) * 3 + 1, t) for i, t in enumerate(corpus(seed))] + [(900, None), (901, "a b c d\n\na b c d e")]
        order = np.random.default_rng(seed).permutation(len(rows))
        df = spark.createDataFrame([(*rows[i], 0) for i in order], "doc_id long, text string, n_lines int").repartition(3)
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed_lines"]) for r in ln.dedup_report(df).collect()}
        assert got == brute(rows)
        assert sum(v[1] for v in got.values()) > 20


def test_text_is_rebuilt_and_odd_rows(spark):
    df = spark.createDataFrame([(1, "one two three\n\nkeep me"), (2, "one two three\nother line"), (2, "one two three\nother line"), (3, None), (None, "keep me\nlast")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 9, r["text"]) for r in ln.remove_repeated_lines(df).collect() if r["doc_id"] != 3)
    assert got == [(1, "one two three\n\nkeep me"), (2, "other line"), (2, "other line"), (9, "last")]
    assert ln.remove_repeated_lines(df).count() == 5
    assert ln.dedup_report(df.limit(0)).count() == 0


def test_report_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "one two three\n\nkeep me", 0), (2, "one two three\nother line", 0), (2, "one two three\nother line", 0), (3, None, 0), (None, "keep me\nlast", 0), (4, "", 0), (2, "new words\none two three", 0)], "doc_id long, text string, removed int")
    got = sorted((r["doc_id"] or 9, r["n_lines"], r["removed_lines"]) for r in ln.dedup_report(df).collect())
    assert got == [(1, 3, ""), (2, 2, "0"), (2, 2, "0"), (2, 2, "1"), (3, 1, ""), (4, 1, ""), (9, 2, "0")]
    assert ln.dedup_report(df.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "one two three\nkeep me"), (2, "one two three four")], "doc_id long, text string")
    plan = ln.dedup_report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_other_white_space_and_only_changed_documents(spark):
    rows = [(1, "a b c d e"), (2, "a\tb\x0bc\x0cd\re\nx y"), (3, "x\t\ty\r"), (4, "p q"), (5, "p q r\n\nx  y\np\tq")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed_lines"]) for r in ln.dedup_report(df).collect()}
    assert got == brute(rows)
    # Documents that keep all lines take no part in the last joins.
    assert sorted((r["id"], r["gone"]) for r in ln.gone_lines(df).collect()) == [(2, [0]), (3, [0]), (5, [2, 3])]
    assert {r["doc_id"]: r["text"] for r in ln.remove_repeated_lines(df).collect()}[5] == "p q r\n"
