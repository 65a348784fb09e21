import hashlib

import numpy as np

from lexiquarry.llm import substrings as ss


def brute(rows, window):
    first = {}
    for doc_id, text in rows:
        w = (text or "").split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, 1 << 62), doc_id)
    out = []
    for doc_id, text in rows:
        w = (text or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc_id:
                gone[i : i + window] = [True] * window
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}é" for i in range(200)]
    passage = list(rng.choice(vocab, 90))
    texts = []
    for i in range(n):
        kind = i % 6
        w = list(rng.choice(vocab, int(rng.integers(0, 400))))
        if kind == 1 and texts:
            w = texts[int(rng.integers(len(texts)))].split()
        if kind == 2:
            w = w[:30] + passage + w[30:]
        if kind == 3 and texts:
            w = texts[int(rng.integers(len(texts)))].split()
            for j in range(20, len(w), 70):
                w[j] = "changed"
        if kind == 4:
            w = w + passage[20:75] + w[:60] + passage
        texts.append("\n ".join(w))
    return texts


def test_matches_brute_force(spark):
    texts = corpus(5)
    order = np.random.default_rng(1).permutation(len(texts))
    rows = [(int(order[i]) * 2, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, " \t")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int").repartition(3)
    got = sorted(tuple(r) for r in ss.remove_repeats(df, 50, 16).collect())
    assert got == brute(rows, 50)
    assert sum(r[2] for r in got) > 1000


def test_small_windows_hot_owner_and_variants(spark, monkeypatch):
    monkeypatch.setattr(ss, "SALT_WORDS", 300)
    monkeypatch.setattr(ss, "SHARD_WORDS", 60)
    rows = list(enumerate(corpus(9, 80)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in ss.remove_repeats(df, 12, 5).collect()) == brute(rows, 12)


def test_same_id_does_not_remove_and_empty_table(spark):
    t = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (2, t + " b"), (None, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 99, r["n_removed"]) for r in ss.remove_repeats(df).collect())
    assert got == [(1, 0), (1, 0), (2, 60), (99, 60)]
    assert ss.remove_repeats(df.limit(0)).count() == 0


def test_automaton_matching_statistics():
    auto = ss.SuffixAutomaton()
    auto.add("abcab")
    auto.add("xbcd")
    assert auto.matching_statistics("zabcd") == [0, 1, 2, 3, 3]
