import hashlib

import numpy as np

from lexiquarry.llm import fingerprint as fp


def brute(texts):
    out = []
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        out.append((len(t), hashlib.sha256(e.encode()).hexdigest(), e))
    return out


def shingle_set(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_matches_brute_force_with_nulls_ties_and_repeats(spark):
    rng = np.random.default_rng(3)
    vocab = ["aé", "b", "cde", "ƒ", "gh"] + [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocab, n)) for n in (0, 3, 7, 80, 400, 1500, 40, 40)] + ["", "x" * 5000, " \n "]
    rows = [(i * 3, t, "extra") for i, t in enumerate(texts)] + [(100, None, "extra"), (None, "the last one", "extra")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = {r["doc_id"]: r for r in fp.fingerprint_documents(df).collect()}
    assert len(got) == len(rows)
    full = texts + ["", "the last one"]
    for i, (n, sha, edited) in enumerate(brute(full)):
        r = got[rows[i][0]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        a, b = shingle_set(full[i]), shingle_set(edited)
        want = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r["near_edited"] - want) < 0.17, (i, want, r["near_edited"])
        assert abs(r["n_shingles"] - len(a)) <= 0.3 * len(a)


def test_equal_texts_have_equal_fingerprints_and_empty_input(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    rows = fp.fingerprint_documents(df).collect()
    assert len(rows) == 3 and len({r["fingerprint"] for r in rows}) == 1 and all(r["near_next"] == 1.0 for r in rows)
    assert fp.fingerprint_documents(df.limit(0)).count() == 0


def test_merge_and_containment():
    def sk(ws):
        raw = " ".join(ws).encode()
        h = fp.sketch_rows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), size=1)[0]
        return fp.encode(h, fp.distinct_count(h))

    a, b = [f"a{i}" for i in range(900)], [f"b{i}" for i in range(300)]
    whole = sk(a + b)
    assert fp.decode(fp.merge(sk(a), sk(b)))[1].tolist() == fp.decode(whole)[1].tolist()
    assert abs(fp.decode(whole)[0] - 1200) < 360
    assert fp.containment(sk(b), whole) > 0.7
    assert fp.containment(whole, sk(b)) < 0.5
