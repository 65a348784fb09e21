"""Clashing names, ties, long texts, nulls and empty tables, for operators and stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import common, decontaminate, fingerprint, lines, manifest, mixing, neardup, negatives, packing, substrings

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")

SCHEMA = "doc_id long, text string, lang string, source string, _id string, _th int, _gone string, _copies int, copy string, id string, th string, row string, gone string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "xx", s, f"id{k}", k, "g", 5, "c", "i", "t", "r", "o") for k, (i, t, s) in enumerate(rows)], SCHEMA)


ROWS = [(1, "one two three four five six\nother line here", "a"), (2, "one two three four five six\nsomething else again", "b"), (3, None, None), (None, "last words of all", "a"), (4, "one two three four five six\nother line here", "a")]


def test_lines_keep_clashing_columns(spark):
    df = clashing(spark, ROWS)
    got = lines.remove_repeated_lines(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    by = {r["_id"]: r for r in got.collect()}
    assert len(by) == 5 and by["id1"]["text"] == "something else again" and by["id4"]["text"] == "" and by["id2"]["text"] is None
    assert all(r["_gone"] == "g" and r["_th"] == int(k[2:]) for k, r in by.items())


def test_near_duplicates_keep_clashing_columns(spark):
    df = clashing(spark, ROWS)
    got = neardup.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r["_id"], r["_th"]) for r in got.collect()) == [("id0", 0), ("id1", 1), ("id2", 2), ("id3", 3)]


def test_mix_keeps_clashing_columns(spark):
    df = clashing(spark, ROWS)
    got = mixing.mix_documents(df)
    assert got.columns == [*df.columns, "copy_2"]
    rows = got.collect()
    assert rows and all(r["_id"] == f"id{r['_th']}" and r["copy"] == "c" and r["_copies"] == 5 for r in rows)


def test_pipeline_stages_on_nulls_and_an_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "the words of an item that nobody has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (ROWS, []):
        docs = clashing(spark, rows)
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert set(docs.columns) <= set(out.columns), name
            out.count()
        kept = {r["_id"] for r in pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()}
        assert "id2" not in kept and (not rows or "id3" in kept)


def test_rows_of_one_id_do_not_depend_on_their_order(spark):
    rng = np.random.default_rng(3)
    rows = [(7 if k % 2 else None, " ".join(f"w{x}" for x in rng.integers(1000, size=12)), "s") for k in range(200)]
    first = mixing.mix_documents(clashing(spark, rows).repartition(3)).select("text", "copy_2").collect()
    again = mixing.mix_documents(clashing(spark, rows[::-1]).repartition(5)).select("text", "copy_2").collect()
    assert sorted(first) == sorted(again)
    docs = clashing(spark, [(7, "same line of many words\nx", "s"), (7, "same line of many words\ny", "s"), (8, "same line of many words", "s")])
    got = sorted((r["doc_id"], r["n_removed"]) for r in lines.dedup_report(docs).collect())
    assert got == [(7, 0), (7, 0), (8, 1)]


def test_very_long_texts(spark):
    rng = np.random.default_rng(4)
    words = [f"w{x}" for x in rng.integers(5000, size=150_000)]
    long = " ".join(words)
    near = " ".join(words[:-50] + ["other"] * 50)
    item = "a benchmark item of some words that stands far inside the long text and nowhere else at all"
    leak = " ".join(words[:90_000]) + " " + item + " " + " ".join(words[90_000:])
    docs = clashing(spark, [(1, long, "s"), (2, near, "s"), (3, leak, "s"), (4, "short one", "s"), (5, "\n".join(words), "t")])
    classes = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicate_classes(docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1}
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()] == [(3, 1)]
    prints = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(docs).collect()}
    assert prints[1]["n_chars"] == len(long) and prints[1]["near_next"] > 0.9 and prints[1]["fingerprint"] == prints[5]["fingerprint"]
    cut = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).collect()}
    assert cut[1] == 0 and cut[2] >= 149_900 and cut[3] == 150_000 and cut[4] == 0 and cut[5] == 150_000
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix_sources(docs).collect()}
    assert sizes[1] == 150_000 and sizes[4] == 2
    gone = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.dedup_report(docs).collect()}
    assert gone[1] == (1, 0) and gone[2] == (1, 1) and gone[3] == (1, 1) and gone[5] == (150_000, 150_000 - len(set(words)))


def test_tables_whose_ids_are_all_null(spark):
    texts = ["one two three four five six seven", "one two three four five six seven", "quite other words stand here in this row", None, " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k}" for k in range(80)) + " end"]
    docs = clashing(spark, [(None, t, "a") for t in texts])
    assert docs.filter("doc_id IS NULL").count() == 6
    classes = neardup.near_duplicate_classes(docs).select("doc_id", "class_th", "is_kept").collect()
    assert len(classes) == 6 and all(r["doc_id"] is None for r in classes) and len({r["class_th"] for r in classes}) == 4
    prints = fingerprint.fingerprint_documents(docs).collect()
    assert len(prints) == 6 and len({r["fingerprint"] for r in prints}) == 5
    assert sorted(r["size"] for r in mixing.mix_sources(docs).collect()) == [0, 7, 7, 8, 80, 81]
    assert sum(r["n_words"] for r in substrings.remove_repeats(docs).collect()) == 183
    packed = packing.pack_documents(docs, PATH).collect()
    assert len({r["sequence_id"] for r in packed}) == len(packed) and all(r["doc_id"] is None for r in packed)
    proofs = manifest.lower_cased(docs.withColumn("n_chars", F.length("text"))).collect()
    assert len(proofs) == 6 and all(r["verified"] for r in proofs) and len({r["root"] for r in proofs}) == 1
    assert negatives.mine_hard_negatives(docs.select(F.col("doc_id").alias("vec_id"), F.lit(1).alias("label"), F.array(F.lit(1)).alias("v")), F.col("vec_id") % 50 == 0).count() == 0


def test_stored_tables_are_cleared_and_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    df = common.stored(spark.range(10))
    assert df.count() == 10
    common.clear_stored(spark)
    with pytest.raises(Exception):  # noqa: B017
        df.count()

    class Unset:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    return type("Sc", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_dir(Unset)
