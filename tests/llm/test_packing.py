"""Packing against the whole-text tokenizer."""

import zlib

import numpy as np
import pytest

from lexiquarry.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ODD = ["", " \t\n", "It's don't we'LL 'sabc x'd O'Neill's rock'n'roll", "a\x1cb x\x85y it\xa0is   z", "é ́a ÉtÉ İstanbul ΣΣ naïve,, über!!", "<|endoftext|>x a<|startoftext|> <|end oftext|>", "1234 a1b2 12.5% v2.0-beta_3", "!!! $$$ *** ... a... ...a", "中文 日本語。 \U0001f600\U0001f600x", "x" * 3000 + " y" * 20]


def encoded(e, texts):
    raw = [t.encode() for t in texts]
    ids, at = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_units_give_the_ids_of_whole_texts(tokenizer):
    e = packing.Encoder(open(PATH, encoding="utf-8").read())
    rng = np.random.default_rng(5)
    texts = list(ODD)
    for alphabet in ("aAbBzZéÉİΣ\u0301'09.,!-_ \n\t\x1c\xa0中½’<|>", "aAbB zZéÉñ.,!-_ \n'0", "aB c.,!?", "ab éЖ中.,!"):
        for k in range(800):
            texts.append("".join(rng.choice(list(alphabet), 60)))
            if k % 40 == 0:
                want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
                assert encoded(e, texts) == want
                texts = [""]


def test_a_full_memory_and_parts_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 20)
    monkeypatch.setattr(packing, "_SLICE", 100)
    e = packing.Encoder(open(PATH, encoding="utf-8").read())
    text = " ".join(ODD * 3)
    for _ in range(3):
        assert e.encode_text(np.frombuffer(text.encode(), np.uint8)).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(e.units) < 400


def test_sequences_rebuild_documents(spark, tokenizer):
    rng = np.random.default_rng(6)
    texts = [*ODD, None, " ".join(rng.choice(["alpha", "Beta,", "x1"], 9000)), "same text", "same text"]
    rows = [(i if i % 7 else None, t, "c") for i, t in enumerate(texts)] + [(3, "of one id", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    got = packing.pack_documents(df, PATH).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    by_length = {}
    for r in got:
        assert r["offset"] == 0 and r["length"] == len(r["ids"]) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_length.setdefault(r["length"], []).append(r["sequence_id"])
    assert all(max(v) - min(v) == len(v) - 1 for v in by_length.values())
    want = sorted((-1 if i is None else i, *(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, _ in rows)
    whole = {}
    for r in sorted(got, key=lambda r: r["start"]):
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    unique = [k for k, v in whole.items() if sum(r["length"] for r in v) == k[1]]
    assert len(unique) >= 10
    for i, n in unique:
        ids = [x for r in whole[(i, n)] for x in r["ids"]]
        assert [r["start"] for r in whole[(i, n)]] == np.cumsum([0] + [r["length"] for r in whole[(i, n)]])[:-1].tolist()
        assert (-1 if i is None else i, *ids) in want
    assert sum(r["length"] for r in got) == sum(len(w) - 1 for w in want)
    thin = packing.pack_documents(df, PATH, with_ids=False)
    assert "ids" not in thin.columns and thin.count() == len(got)


def test_empty_table_lengths_and_buckets_on_disk(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(df, PATH).count() == 0
    assert packing.piece_lengths(4096 * 2 + 5) == [4096, 4096, 4, 1]
    assert packing.piece_lengths(1) == [1]
    with pytest.raises(ValueError, match="power of two"):
        packing.pack_documents(df, PATH, context=1000)
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    packing.write_buckets(packing.pack_documents(docs, PATH, context=2), f"{tmp_path}/b")
    back = spark.read.parquet(f"{tmp_path}/b").collect()
    assert sorted(r["length"] for r in back) == [1, 2, 2]
