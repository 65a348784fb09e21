import json
import time

import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import line_passes as lp
from lexiquarry.functions import text as t
from lexiquarry.operators import documents as o
from lexiquarry.sources import readers as rd
from lexiquarry.sources import writers as wr
from lexiquarry.streaming import queue as q


def test_line_passes():
    assert lp.join_spaced_letters("B Ộ XÂY D Ự NG ngày hôm nay") .startswith("BỘ")
    assert lp.strip_header("CHÍNH PHỦ\nSố: 12/NĐ\n\nĐiều 1. Nội dung chính") == "Điều 1. Nội dung chính"
    assert lp.strip_recipients("a\nNơi nhận:\n- Bộ A;\n- Lưu VT.\nb") == "a\nb"
    assert lp.rejoin_paragraphs("one line\ngoes on.\nNext") == "one line goes on.\nNext"
    assert lp.drop_orphan_numbers("a\n\n12\nb") == "a\n\nb"
    assert lp.joined_pages(["ends within", "the sentence.\nNew"]) == ["ends within the sentence.", "New"]


def test_patches():
    base = "# T\nA {#a}\nold\n## B {#b}\nkeep\n"
    out = lp.patched(base, [{"action": "REPLACE", "anchor": "a", "content": "A {#a}\nnew"}, {"action": "REPEAL", "anchor": "b"}, {"action": "REPLACE", "anchor": "zz", "content": "x"}, {"action": "APPEND", "content": "end"}])
    assert out == "# T\nA {#a}\nnew\n[repealed]\nend\n"


def test_token_bucket_and_circuit():
    step, s, got = q.token_bucket(2, 1.0), {}, []
    for x in (0, 0, 0, 1, 1):
        s, d = step(s, float(x), 1.0)
        got.append(d)
    assert got == ["allow", "allow", "deny", "allow", "deny"]
    step, s, got = q.circuit_breaker(2, 60), {}, []
    for x, bad in ((0, 1), (1, 1), (2, 0), (70, 0), (71, 1)):
        s, d = step(s, float(x), float(bad))
        got.append(d)
    assert got == ["CLOSED", "CLOSED", "OPEN", "HALF_OPEN", "CLOSED"]


@pytest.mark.parametrize("make", [lambda: q.token_bucket(2, 0.1), lambda: q.retry_queue(2), lambda: q.ttl_cache(5.0), lambda: q.cooldown(3.0), lambda: q.circuit_breaker(2, 4.0)])
def test_stream_gives_what_the_batch_gives(spark, tmp_path, make):
    rows = [(f"k{i % 3}", i, float(i), float(i % 4 == 0)) for i in range(40)]
    schema = "key string, seq long, seconds double, value double"
    for k in range(4):
        part = spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    want = sorted(tuple(r) for r in q.fold_batch(spark.createDataFrame(rows, schema), make()).collect())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = q.fold_stream(stream, make()).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want


def test_markdown_and_exports(spark, tmp_path):
    (tmp_path / "a.md").write_text("\ufeff---\ntitle: x\n---\n# Body\n")
    assert rd.markdown_pages(spark, str(tmp_path / "a.md")).first()["text"] == "# Body\n"
    doc = {"doc_id": "d", "summary": "s", "metadata": {"doc_type": "T"}, "chunks": [{"text": "one", "page": 1}, {"text": "two", "page": 2}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    assert [(r["n"], r["text"], r["doc_type"]) for r in rd.export_chunks(spark, str(tmp_path / "d.json")).orderBy("n").collect()] == [(0, "one", "T"), (1, "two", "T")]
    (tmp_path / "q.jsonl").write_text('{"question": "a", "other": 1}\nnot json\n{"question": "b", "expected_doc_numbers": ["1"]}\n')
    assert {r["question"] for r in rd.qa_list(spark, str(tmp_path / "q.jsonl")).collect() if r["question"]} == {"a", "b"}
    wr.write_archive(spark.range(5), f"{tmp_path}/archive")
    assert spark.read.json(f"{tmp_path}/archive").count() == 5


def test_extractor_failures_are_rows(spark):
    files = spark.createDataFrame([("a", bytearray(b"x|y")), ("b", bytearray(b"bad"))], "path string, content binary")

    def extract(content):
        if content == b"bad":
            raise ValueError("broken")
        return content.decode().split("|")

    got = sorted((r["path"], r["page"], r["text"], r["error"]) for r in rd.extracted_pages(files, extract).collect())
    assert got == [("a", 1, "x", None), ("a", 2, "y", None), ("b", 1, "", "broken")]


def test_packing(spark):
    text = "A" * 200 + ". " + "B" * 150 + ". " + "C" * 320 + ". " + "D" * 60
    df = spark.createDataFrame([(1, text), (2, "tiny"), (3, None)], "k int, s string")
    got = {r["k"]: r["p"] for r in df.select("k", o.packed_sentences(F.col("s")).alias("p")).collect()}
    assert [len(x) for x in got[1]] == [351, 381] and got[2] == [] and got[3] is None


def test_paragraphs_and_canonical_ids_of_nulls(spark):
    r = spark.createDataFrame([(None,)], "s string").select(t.dedup_paragraphs(F.col("s")).alias("a"), t.polarity(F.col("s")).alias("b")).first()
    assert (r["a"], r["b"]) == (None, 0)
