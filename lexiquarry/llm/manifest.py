"""A Merkle manifest of a table of documents.

Every row is a leaf: the sha256 of doc_id, source, lang, n_chars and text, each written as
``-`` if null, else as UTF-8 byte count, ``:`` and value. Leaves of one language ascend by
doc_id. Runs of ``FANOUT`` neighbours are hashed together, level by level, until one node, the
subroot, remains; subroots in the order of languages are hashed to the root in the same way.
A proof holds a leaf's siblings on all levels, so that a changed row is found from its own
content, its proof and the root alone.

A tree is cut into aligned blocks of ``BLOCK`` leaves. In a block the digests are one
contiguous matrix of 64-byte rows: a level is hashed by reshaping it by the fanout, and the
siblings of a node are found by index arithmetic. Roots of blocks are the leaves of the next
tier, until a tree has one; then paths go back down, a row for each block. So no group has
more than ``BLOCK`` rows, no language is one task's, and the digests of a tier are a
4096th of those below it. Places in a language come from a sort by ranges, split anywhere,
and the number of rows of each language in each range. Texts are hashed where they are read.

Defined results: nulls are written as ``-``, so a null and an empty text differ; null doc_id
comes last in its language, and is never tampered with; null lang is a language, the first;
rows of one language and doc_id stand by their leaf, so repeated rows have one leaf and
neighbouring places; a text of any length is one value; other columns are ignored, whatever
their names; an empty table gives an empty table, and has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.llm.common import shuffle_width, stored

FANOUT = 8
#: Leaves of a block: a power of the fanout.
BLOCK = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(column) -> object:
    """A value of a leaf: ``-`` if null, else byte count, colon, value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text=None) -> object:
    """The leaf of a row, or what it would be with another text."""
    first = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*first, field(F.col("text") if text is None else text)), 256)


def _h(digests: bytes) -> bytes:
    return hashlib.sha256(digests).hexdigest().encode()


def block_levels(leaves: np.ndarray, depth: int, fanout: int = FANOUT) -> list[np.ndarray]:
    """The levels of a block, leaves first: a matrix of 64-byte rows for each. ``depth``
    levels are hashed, also from one node."""
    levels = [np.ascontiguousarray(leaves).reshape(-1, 64)]
    for _ in range(depth):
        below = levels[-1]
        whole = len(below) // fanout
        rows = [_h(row) for row in below[: whole * fanout].reshape(whole, fanout * 64)]
        if whole * fanout < len(below):
            rows.append(_h(below[whole * fanout :]))
        levels.append(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 64))
    return levels


def siblings(levels: list[np.ndarray], index: int, fanout: int = FANOUT) -> list[tuple[bytes, bytes]]:
    """(left, right) siblings of a leaf on each level but the last."""
    out = []
    for level in levels[:-1]:
        first = index - index % fanout
        out.append((level[first:index].tobytes(), level[index + 1 : first + fanout].tobytes()))
        index //= fanout
    return out


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root from a leaf and its siblings."""
    for left, right in path:
        leaf = _h(left + leaf + right)
    return leaf


def proof_digest(path: list[tuple[bytes, bytes]]) -> str:
    return hashlib.sha256(b"".join(left + right for left, right in path)).hexdigest()


def depth_of(nodes: int, most: int, fanout: int = FANOUT) -> int:
    """Levels above so many nodes, ``most`` at most."""
    depth = 0
    while nodes > 1 and depth < most:
        nodes, depth = -(-nodes // fanout), depth + 1
    return depth


def _log(block: int, fanout: int) -> int:
    depth = depth_of(block, 64, fanout)
    if fanout < 2 or fanout**depth != block:
        raise ValueError("a block must be a power of the fanout")
    return depth


def _placed(rows: DataFrame, tree: str, order: list) -> DataFrame:
    """rows with ``pos``, their place in their tree, and ``nodes``, how many it has. Ranges
    of the order may cut a tree anywhere; a tree's rows before a range are counted."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    kept = dealt.schema.names
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", nth long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = 0, object()
        for b in batches:
            names = b.column(kept.index(tree)).to_pylist()
            nth = np.zeros(b.num_rows, np.int64)
            for i, name in enumerate(names):
                if name != last:
                    at, last = 0, name
                nth[i], at = at, at + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nth)], [*kept, "nth"])

    held = stored(dealt.mapInArrow(number, schema).withColumn("range", F.spark_partition_id()))
    same = W.partitionBy(tree)
    counts = held.groupBy(tree, "range").agg(F.count("*").alias("n"))
    counts = counts.select(F.col(tree).alias("_tree"), F.col("range").alias("_range"), F.coalesce(F.sum("n").over(same.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("n").over(same).alias("nodes"))
    out = held.join(counts, held[tree].eqNullSafe(counts["_tree"]) & (held["range"] == counts["_range"]))
    return out.select(*kept, (F.col("_before") + F.col("nth")).alias("pos"), "nodes")


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    """A column of 64 hex digits as a matrix of bytes."""
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, 64)


def _roots(nodes: DataFrame, block: int, fanout: int) -> DataFrame:
    """(tree, pos, nodes, digest): the roots of all blocks of (tree, pos, nodes, digest)."""
    most = _log(block, fanout)

    def top(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        total = t["nodes"][0].as_py()
        levels = block_levels(_digests(t["digest"]), depth_of(total, most, fanout), fanout)
        return pa.table({"tree": t["tree"][:1], "pos": pa.array([t["pos"][0].as_py() // block], pa.int64()), "nodes": pa.array([-(-total // block)], pa.int64()), "digest": pa.array([levels[-1].tobytes().decode()])})

    key = [F.col("tree"), F.expr(f"pos div {block}").alias("at")]
    return nodes.groupBy(*key).applyInArrow(top, "tree string, pos long, nodes long, digest string")


PATH = "array<struct<l: binary, r: binary>>"


def _paths(nodes: DataFrame, above: DataFrame, block: int, fanout: int) -> DataFrame:
    """(tree, pos, path, root): the path of every node to its tree's root and beyond, from
    (tree, pos, path, root) of the blocks above."""
    most = _log(block, fanout)

    def down(key, t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        levels = block_levels(_digests(t["digest"]), depth_of(t["nodes"][0].as_py(), most, fanout), fanout)
        rest = [(p["l"], p["r"]) for p in up["path"][0].as_py()]
        first = t["pos"][0].as_py()
        paths = [[{"l": left, "r": right} for left, right in siblings(levels, p - first, fanout) + rest] for p in t["pos"].to_pylist()]
        return pa.table({"tree": t["tree"], "pos": t["pos"], "path": pa.array(paths, pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))), "root": pa.array([up["root"][0].as_py()] * len(t))})

    return _beside(nodes, above, block).applyInArrow(down, f"tree string, pos long, path {PATH}, root string")


def _beside(nodes: DataFrame, above: DataFrame, block: int):
    """Blocks of nodes, each with its row from above."""
    below = nodes.groupBy(F.col("tree").alias("in_tree"), F.expr(f"pos div {block}").alias("at"))
    return below.cogroup(above.groupBy(F.col("tree").alias("in_tree"), F.col("pos").alias("at")))


def _climb(nodes: DataFrame, block: int, fanout: int) -> list[DataFrame]:
    """Tiers of all trees, from the given nodes to one node for each tree. Trees of fewer
    nodes wait as one node, which no level changes."""
    tiers = [nodes]
    while tiers[-1].filter("nodes > 1").limit(1).count():
        tiers.append(stored(_roots(tiers[-1], block, fanout)))
    return tiers


def merkle_manifest(docs: DataFrame, tampered=None, when=None, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """Proofs of every document of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, lang,
    leaf, subroot, root, proof_sha256, folded_root, verified. ``tampered`` is the text
    that is held against the manifest in rows where ``when`` is true; elsewhere, and where
    neither is given, it is the row's own."""
    _log(block, fanout)
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("tree"), leaf_digest().alias("leaf")]
    other = F.lit(None).cast("string") if tampered is None else F.when(F.lit(True) if when is None else when, leaf_digest(tampered))
    leaves = stored(docs.select(*cols, other.alias("other")))
    placed = stored(_placed(leaves, "tree", [F.col("tree").asc_nulls_first(), F.col("doc_id").asc_nulls_last(), F.col("leaf")]))
    tiers = _climb(placed.select("tree", "pos", "nodes", F.col("leaf").alias("digest")), block, fanout)
    named = tiers[-1].select(F.col("tree").alias("lang"), F.lit("").alias("tree"), "digest")
    subroots = stored(_placed(named, "tree", [F.col("tree"), F.col("lang").asc_nulls_first()]))
    top = _climb(subroots.select("tree", "pos", "nodes", "digest"), block, fanout)

    above = top[-1].select("tree", "pos", F.lit(None).cast(PATH).alias("path"), F.col("digest").alias("root"))
    above = above.withColumn("path", F.expr(f"cast(array() as {PATH})"))
    for tier in reversed(top[:-1]):
        above = stored(_paths(tier, above, block, fanout))
    up = stored(subroots.select("lang", "pos", "digest").join(above.select("pos", "path", "root"), "pos").select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "root", "digest"))
    names = up.select(F.col("tree").alias("_tree"), F.col("digest").alias("subroot"))
    above = up.drop("digest")
    for tier in reversed(tiers[1:-1]):
        above = stored(_paths(tier, above, block, fanout))
    proofs = _proofs(placed, above, block, fanout)
    out = proofs.join(names, proofs["tree"].eqNullSafe(names["_tree"]))
    return out.select("doc_id", F.col("tree").alias("lang"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _proofs(placed: DataFrame, above: DataFrame, block: int, fanout: int) -> DataFrame:
    """Proof digests and folded roots of all leaves, from the paths of their blocks."""
    most = _log(block, fanout)

    def prove(key, t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        levels = block_levels(_digests(t["leaf"]), depth_of(t["nodes"][0].as_py(), most, fanout), fanout)
        rest = [(p["l"], p["r"]) for p in up["path"][0].as_py()]
        tail = b"".join(left + right for left, right in rest)
        root, first = up["root"][0].as_py(), t["pos"][0].as_py()
        proofs, folded = [], []
        for p, leaf, other in zip(t["pos"].to_pylist(), t["leaf"].to_pylist(), t["other"].to_pylist(), strict=True):
            path = siblings(levels, p - first, fanout)
            proofs.append(hashlib.sha256(b"".join(left + right for left, right in path) + tail).hexdigest())
            folded.append(fold((leaf if other is None else other).encode(), path + rest).decode())
        return pa.table({"doc_id": t["doc_id"], "tree": t["tree"], "pos": t["pos"], "leaf": t["leaf"], "root": pa.array([root] * len(t)), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded)})

    return _beside(placed, above, block).applyInArrow(prove, "doc_id long, tree string, pos long, leaf string, root string, proof_sha256 string, folded_root string")


def lower_cased(docs: DataFrame) -> DataFrame:
    """The manifest held against a copy whose texts are lower-cased (A to Z) where 3 divides
    the crc32 of the doc_id's digits."""
    return merkle_manifest(docs, F.translate("text", _UPPER, _LOWER), F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 0)


def oracle(levels: int = 7) -> str:
    """SQL over ``documents``, for at most 8 ** levels rows of a language and as many languages."""
    text = "coalesce(strlen({0}) || ':' || {0}, '-')"
    leaf = "sha256(" + " || ".join([*(text.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars")), text.format("{0}")]) + ")"
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, c: list_reduce(list_prepend(xor(x, c), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
    ctes = [
        f"told AS (SELECT doc_id, lang, {leaf.format('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other FROM documents)",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM told)",
        "a0 AS (SELECT lang AS tree, pos, n, leaf AS digest FROM leaves)",
    ]
    around = "coalesce(string_agg(digest, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN {}), '') AS {}"

    def tree(t: str) -> None:
        for k in range(levels):
            sides = ", ".join(around.format(*x) for x in (("UNBOUNDED PRECEDING AND 1 PRECEDING", "l"), ("1 FOLLOWING AND UNBOUNDED FOLLOWING", "r")))
            ctes.append(f"{t}{k}s AS (SELECT *, {sides} FROM {t}{k})")
            ctes.append(f"{t}{k + 1} AS (SELECT tree, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {t}{k} GROUP BY tree, pos // 8, n)")

    tree("a")
    ctes.append(f"b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, digest, tree AS lang FROM a{levels})")
    tree("b")
    ctes.append("f0 AS (SELECT l.doc_id, l.lang, l.leaf, coalesce(l.other, l.leaf) AS now, '' AS proof, l.pos AS pos FROM leaves l)")
    step = "SELECT f.doc_id, f.lang, f.leaf, f.pos // 8 AS pos, CASE WHEN s.n = 1 THEN f.now ELSE sha256(s.l || f.now || s.r) END AS now, CASE WHEN s.n = 1 THEN f.proof ELSE f.proof || s.l || s.r END AS proof"
    for k in range(levels):
        ctes.append(f"f{k + 1} AS ({step} FROM f{k} f JOIN a{k}s s ON s.tree IS NOT DISTINCT FROM f.lang AND s.pos = f.pos)")
    ctes.append(f"g0 AS (SELECT f.doc_id, f.lang, f.leaf, f.now, f.proof, b.pos FROM f{levels} f JOIN b0 b ON b.lang IS NOT DISTINCT FROM f.lang)")
    for k in range(levels):
        ctes.append(f"g{k + 1} AS ({step} FROM g{k} f JOIN b{k}s s ON s.pos = f.pos)")
    last = f"SELECT g.doc_id, g.lang, g.leaf, b.digest AS subroot, r.digest AS root, sha256(g.proof) AS proof_sha256, g.now AS folded_root, g.now = r.digest AS verified FROM g{levels} g JOIN b0 b ON b.lang IS NOT DISTINCT FROM g.lang CROSS JOIN b{levels} r"
    return "WITH " + ",\n".join(ctes) + "\n" + last
