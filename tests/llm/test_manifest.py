"""The manifest against trees built row by row, and against SQL."""

import hashlib
import zlib

import duckdb
import pytest

from lexiquarry.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """root and, for each node, its siblings by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i in range(len(paths)):
            run = at[i] // 8 * 8
            paths[i].append((nodes[run : at[i]], nodes[at[i] + 1 : run + 8]))
            at[i] //= 8
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    subs, told = [], []
    for lang in langs:
        mine = sorted(((r[0] is None, r[0] or 0, leaf_of(*r), r) for r in rows if r[2] == lang), key=lambda x: x[:3])
        root, paths = tree([m[2] for m in mine])
        subs.append(root)
        told.append([(m[3], m[2], p) for m, p in zip(mine, paths, strict=True)])
    root, above = tree(subs)
    out = []
    for sub, up, mine in zip(subs, above, told, strict=True):
        for r, leaf, path in mine:
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                now = leaf_of(*r[:4], low)
            for left, right in path + up:
                now = h(*left, now, *right)
            proof = h(*(x for left, right in path + up for x in left + right))
            out.append((r[0], leaf, sub, root, proof, now, now == root))
    return sorted(out, key=str)


def rows_of(n, langs):
    return [(i * 3 % 1000 if i % 97 else None, [None, "web", "é"][i % 3], langs[i * i % len(langs)], i if i % 5 else None, [None, "", f"Text {i} ÀB", f"lower {i}", "Z" * i][i % 5]) for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize(("n", "langs", "block"), [(1, ["en"], 8), (700, ["en", "en", "en", None, "é", "de", "Z"], 8), (700, ["en", "en", None], 64), (300, [f"l{k}" for k in range(30)], 8), (64, ["x"], 64)])
def test_trees_equal_those_built_row_by_row(spark, n, langs, block):
    rows = rows_of(n, langs) + ([rows_of(n, langs)[0]] * 3 if n > 1 else [])
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", tree string, pos int").repartition(3)
    got = manifest.merkle_manifest(df, manifest.F.translate("text", manifest._UPPER, manifest._LOWER), manifest.F.crc32(manifest.F.col("doc_id").cast("string")) % 3 == 0, block=block)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == brute(rows)


def test_query_form_equals_sql_and_an_empty_table_is_empty(spark):
    rows = rows_of(400, ["en", "de", None, "fr"])
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in manifest.lower_cased(df).collect()), key=str)
    assert got == brute(rows) and any(not g[-1] for g in got) and any(g[-1] for g in got)
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({manifest.oracle(4)})").fetchall()
    assert sorted(want, key=str) == got
    assert manifest.lower_cased(df.limit(0)).count() == 0
    untouched = manifest.merkle_manifest(df).select("verified").distinct().collect()
    assert [r[0] for r in untouched] == [True]


def test_any_change_to_a_row_is_found(spark):
    rows = rows_of(100, ["en", "de"])
    df = spark.createDataFrame(rows, SCHEMA)
    got = manifest.merkle_manifest(df, manifest.F.concat(manifest.F.coalesce("text", manifest.F.lit("")), manifest.F.lit("")))
    null_texts = {r[0] for r in rows if r[4] is None}
    bad = {r["doc_id"] for r in got.filter("not verified").collect()}
    assert bad == null_texts  # a null and an empty text differ
    with pytest.raises(ValueError, match="power of the fanout"):
        manifest.merkle_manifest(df, block=100)
