import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def make(spark, path):
    rng = np.random.default_rng(8)
    roots = {"xa": ["dra", "mok", "lun", "teg", "bor"], "yb": ["fis", "pul", "wor", "nan", "hik"]}

    def line(lang, n):
        return " ".join("".join(rng.choice(roots[lang], 4)) for _ in range(n))

    items = [(i, line("xa", 30)) for i in range(3)]
    rows = []
    for i in range(60):
        lang = ["xa", "yb"][i % 2]
        text = "\n".join(line(lang, 20) for _ in range(6))
        rows.append([i, text, lang, f"s{i % 3}", len(text)])
    rows[10][1] = rows[4][1]  # a copy
    rows[20][1] += "\nshared closing line of seven words here"
    rows[21][1] += "\nshared closing line of seven words here"
    rows[30][1] += "\n" + items[1][1]  # a leak
    rows.append([60, "12 34 !!", "xa", "s0", 8])
    rows.append([61, None, None, None, None])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return rows


def test_stages_take_effect(spark, tmp_path):
    rows = make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        if name != "mix_sources":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(seen["language_id"]) == set(range(60))
    assert seen["line_dedup"][10] == "" and seen["line_dedup"][21] == rows[21][1].rpartition("\n")[0] and seen["line_dedup"][20] == rows[20][1]
    assert set(seen["near_dedup"]) == set(range(60))
    assert set(seen["decontaminate"]) == set(range(60)) - {30}
    assert set(seen["mix_sources"]) <= set(seen["decontaminate"]) and len(seen["mix_sources"]) > 20


def test_run_gives_the_stages_rows(spark, tmp_path):
    make(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    words = {}
    for r in out.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    total = sum(words.values())
    assert abs(words["s0"] / total - 5 / 8) < 0.06 and abs(words["s1"] / total - 2 / 8) < 0.06
