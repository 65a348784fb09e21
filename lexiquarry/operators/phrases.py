"""Phrases in texts by an automaton: each text is read once, however many phrases there are."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of phrases in one automaton; more are looked for in further passes.
MOST = 4 << 20


def phrase_hits(docs: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """(key, ids): of each text the ids of the ``phrases`` (id, phrase) that it contains, in
    either case, sorted. ``key`` is a row's own; null texts and empty phrases meet nothing."""
    named = phrases.select(F.col("id").cast("long").alias("id"), F.lower("phrase").alias("phrase")).filter("phrase != ''")
    size = named.agg(F.sum(F.length("phrase"))).first()[0] or 0
    passes = 1 + size // MOST
    kind = docs.schema[key].dataType.simpleString()
    found = None
    for k in range(passes):
        rows = named.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == k).collect()  # about MOST characters
        of: dict[str, list[int]] = {}
        for r in rows:
            of.setdefault(r["phrase"], []).append(r["id"])

        def look(batches: Iterator[pa.RecordBatch], of: dict[str, list[int]] = of) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for phrase, ids in of.items():
                machine.add_word(phrase, ids)
            if of:
                machine.make_automaton()
            for b in batches:
                hits = [sorted({i for _, ids in machine.iter(t.as_py()) for i in ids}) if of else [] for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.list_(pa.int64()))], [key, "ids"])

        one = docs.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("text")).mapInArrow(look, f"{key} {kind}, ids array<long>")
        found = one if found is None else found.unionByName(one)
    if passes == 1:
        return found
    return found.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))


def phrase_scores(docs: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """(key, hits, misses, banned, score) by ``phrases`` (id, phrase, is_banned): which of the wanted ones
    a text has and lacks, which of the banned it has, and 100 hits / wanted less 10 for each of
    the latter, 0 at least and rounded to a tenth."""
    ids = lambda c: F.coalesce(F.array_sort(F.collect_list(F.when(c, F.col("id").cast("long")))), F.array().cast("array<long>"))
    sides = phrases.agg(ids(~F.col("is_banned")).alias("wanted"), ids(F.col("is_banned")).alias("unwanted"))
    out = phrase_hits(docs, key, text, phrases).join(F.broadcast(sides))
    out = out.select(key, F.array_intersect("wanted", "ids").alias("hits"), F.array_except("wanted", "ids").alias("misses"), F.array_intersect("unwanted", "ids").alias("banned"))
    n = F.size("hits") + F.size("misses")
    share = F.when(n > 0, 100.0 * F.size("hits") / n).otherwise(0.0)
    return out.withColumn("score", F.round(F.greatest(share - 10.0 * F.size("banned"), F.lit(0.0)), 1))
