import numpy as np

from lexiquarry.llm import decontaminate as dc


def make(seed=0):
    rng = np.random.default_rng(seed)
    rare = ["".join(rng.choice(list("abcdefghijklmnoprstuvé"), 6)) for _ in range(4000)]
    common = ["the", "of", "and", "to", "in", "is", "it", "for"]

    def text(n):
        return " ".join(str(rng.choice(common)) if rng.random() < 0.4 else str(rng.choice(rare)) for _ in range(n))

    items = [(i, text(int(rng.integers(14, 70))).capitalize() + ". " + text(6).capitalize() + ".") for i in range(40)]
    docs, truth = [], set()
    for i in range(300):
        body = text(int(rng.integers(0, 400)))
        if i % 5 == 0:
            k = int(rng.integers(len(items)))
            w = items[k][1].split()
            if i % 10 == 0:  # a paraphrase: some words changed, dropped or added
                w = [str(rng.choice(rare)) if rng.random() < 0.12 else x for x in w if rng.random() > 0.05]
            body = text(30) + " " + " ".join(w) + "\n" + body
            truth.add((i, k))
        docs.append((i, body))
    return docs, items, truth


def test_finds_planted_copies_and_paraphrases_only(spark):
    docs, items, truth = make()
    d = spark.createDataFrame([(*r, 0.5) for r in docs] + [(900, None, 0.1), (901, "", 0.1), (None, items[3][1].upper(), 0.1)], "doc_id long, text string, cosine double").repartition(4)
    b = spark.createDataFrame(items + [(77, None), (78, " ")], "item_id long, text string").repartition(2)
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(d, b).collect()}
    assert (None, 3) in got
    got.discard((None, 3))
    assert got <= truth and len(got & truth) >= 0.95 * len(truth)
    kept = {r["doc_id"] for r in dc.drop_leaking(d, b).collect()}
    assert kept == {i for i, _ in docs if i not in {x for x, _ in got}} | {900, 901}
    assert dc.find_leaks(d.limit(0), b).count() == 0 and dc.find_leaks(d, b.limit(0)).count() == 0


def test_latent_candidates_against_brute_force_cosine(spark):
    docs, items, _ = make(4)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = dc.build_index(d, b).opened()
    dense = np.zeros((len(items), dc.FEATURES), np.float32)
    for k, w in enumerate(index.words):
        f, x, size = dc._weights(w, index.idf)
        dense[k, f] = x / size
    found, want = set(), set()
    for doc_id, text in docs:
        words = dc._item_words(text)
        first = np.array([0, len(words)])
        found |= {(doc_id, s, k) for _, s, k, _ in dc._candidates(words, first, index, dc.WINDOW, dc.COSINE)}
        for s in range(0, max(1, len(words) - dc.WINDOW + dc.WINDOW // 2), dc.WINDOW // 2):
            f, x, size = dc._weights(words[s : s + dc.WINDOW], index.idf)
            if size:
                want |= {(doc_id, s, int(k)) for k in np.flatnonzero(dense[:, f] @ (x / size) >= dc.COSINE)}
    assert want and len(found & want) >= 0.95 * len(want)


def test_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 5, 12).tolist(), rng.integers(0, 5, 9).tolist()
        t = [[0] * 10 for _ in range(13)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert dc.common_subsequence(a, b) == t[12][9]


def test_item_that_many_documents_hold_is_found_in_all(spark):
    docs, items, _ = make(5)
    for every in (3, 1):
        d = [(i, f"{text[:300]} {items[0][1]} {text[300:600]}" if i % every == 0 else text) for i, text in docs]
        leaks = dc.find_leaks(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert {r["doc_id"] for r in leaks.collect() if r["item_id"] == 0} >= set(range(0, 300, every))


def test_every_item_of_a_benchmark_beyond_the_rank_is_found(spark, monkeypatch):
    monkeypatch.setattr(dc, "PART", 400, raising=False)
    rng = np.random.default_rng(6)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    items = [(i, text(30)) for i in range(600)]
    d = spark.createDataFrame([(i, f"{text(50)} {item} {text(50)}") for i, item in items], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(d, b).collect()} >= {(i, i) for i, _ in items}
    assert dc.drop_leaking(d, b).count() == 0


def test_paraphrases_of_short_items_against_brute_force_over_the_rule(spark):
    docs, items, _ = make(7)
    rng = np.random.default_rng(8)
    items = [(i, " ".join(text.split()[:14]) + ".") for i, text in items]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = dc.build_index(d, b).opened()
    long = [text.split() for _, text in docs if len(text.split()) > 200]
    want = found = 0
    for trial in range(400):
        k, body, other = trial % len(items), long[rng.integers(len(long))], long[rng.integers(len(long))]
        w = [str(rng.choice(other)) if rng.random() < 0.3 else x for x in items[k][1].split()]
        at = int(rng.integers(60, 120))
        words = dc._item_words(" ".join(body[:at] + w + body[at : at + 80]))
        target, answer = index.words[k], index.answers[k]
        for s in range(0, len(words) - dc.WINDOW // 2, dc.WINDOW // 2):
            near = words[max(0, s - len(target)) : s + dc.WINDOW + len(target)].tolist()
            share = dc.common_subsequence(near, target.tolist()) / len(target)
            if share >= dc.COPY or (share >= dc.PARAPHRASE and len(answer & set(near)) >= dc.ANSWER * len(answer)):
                want += 1
                found += (0, k) in dc.leaks_of(words, np.array([0, len(words)]), index)
                break
    assert want > 300 and found >= 0.99 * want


def test_long_items_are_found(spark):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n))
    items = [(n, text(n)) for n in (400, 600, 1000)]
    docs = [(n, f"{text(100)} {item} {text(100)}") for n, item in items] + [(0, text(900))]
    leaks = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in leaks.collect() if r["lcs"] == 1} == {(n, n) for n, _ in items}


def test_ruling_out_by_groups_of_passages_loses_no_window(spark):
    docs, items, _ = make(6)
    index = dc.build_index(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).opened()
    texts = [dc._item_words(t) for _, t in docs]
    words, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    screened = set(c[:3] for c in dc._candidates(words, first, index, dc.WINDOW, dc.COSINE))
    for block in index.blocks:
        block.shares = np.ones_like(block.shares)  # rules out no window that has a word of the block
    every = set(c[:3] for c in dc._candidates(words, first, index, dc.WINDOW, dc.COSINE))
    assert screened == every and len(every) > 50


def test_a_subsequence_is_no_longer_than_the_words_that_are_there():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 9, int(rng.integers(0, 40))).tolist(), rng.integers(0, 12, int(rng.integers(1, 20))).tolist()
        assert dc.common_subsequence(a, b) <= sum(x in set(a) for x in b)
