import numpy as np

from lexiquarry.llm import neardup as nd


def shingles(t):
    w = (t or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, t=0.8):
    sets = [shingles(x) for _, x in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if u == 0 or len(sets[i] & sets[j]) / u >= t - 1e-12:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), set()).add(d)
    return sorted(map(sorted, groups.values()))


def classes(df, **kw):
    out = {}
    for r in nd.near_duplicate_classes(df, **kw).collect():
        out.setdefault((r["class_id"], r["class_th"]), set()).add(r["doc_id"])
    return sorted(map(sorted, out.values()))


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(vocab, 300))
    texts = []
    for i in range(70):  # variants of one text, from nearly equal to quite different
        w = list(base)
        for p in rng.choice(300, int(rng.integers(0, 22)), replace=False):
            w[p] = f"x{i}_{p}"
        texts.append(" ".join(w))
    for n in (3, 4, 5, 9, 60, 200, 1000):
        texts += [" ".join(rng.choice(vocab, n)) for _ in range(3)]
    texts += texts[:5] + [texts[-1]] * 4 + ["", " \n", None, "one", "one"]
    return texts


def test_matches_brute_force(spark):
    texts = corpus(2)
    order = np.random.default_rng(4).permutation(len(texts))
    rows = sorted((int(order[i]), t) for i, t in enumerate(texts))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, class_id string").repartition(4)
    assert classes(df) == brute(rows)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words here"), (2, "a b c d e f g"), (None, None)], "doc_id long, text string")
    kept = sorted((r["doc_id"] or 9, r["text"] or "") for r in nd.drop_near_duplicates(df).collect())
    assert kept == [(1, "a b c d e f g"), (1, "other words here"), (9, "")]
    assert nd.near_duplicate_classes(df.limit(0)).count() == 0


def test_registers_estimate_probability_jaccard():
    n, m = 400, 4096
    a = np.arange(1, n + 1, dtype=np.uint64)
    values = nd.tc.mix64(np.concatenate([a, a[100:], np.arange(1000, 1100, dtype=np.uint64)]))
    rows = np.repeat([0, 1], n)
    s = nd.probminhash(values, np.ones(2 * n), rows, 2, m)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.04
    assert (s != 0).all()
