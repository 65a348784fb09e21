"""Mixing sources to target weights by systematic sampling, in DataFrame operations.

A document's size is its number of words. Sources in code-point order (null last) weigh
5, 2, 1, repeating, and share the corpus's size; no target goes above ``cap`` times its
source, what is above is shared again by weight (a water level over cap * size / weight).
Every document of a source expects target / source size copies. The prefix sum of these
over the source, plus one offset for each source, crosses an integer once for each copy.
Documents stand in order of size class, so that the copies' words come near the target.

The prefix sums have two levels: ranks within blocks (source, size class, salt) and sums
of whole blocks before. The number of salts grows with the square root of the rows, so
no source, however large, is one task's. Only the table of sources is in one task.

Defined results: null text has size 0; null source is a source of its own, the last; a
source of size 0 has target 0; repeated rows are documents of their own (in the mix itself
one document with the copies of all); rows of one size and doc_id are told apart by their
text's hash; texts may have any length; an empty table gives an empty table; other columns
are ignored, whatever their names. The offset comes from the source's name, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.llm.common import WORD, cut, row_key

WEIGHTS = (5, 2, 1)
CAP = 3


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row for each source: source, source_size, target."""
    whole = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    named = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    filled = W.partitionBy(F.lit(0)).orderBy("level", "n")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("n", F.row_number().over(named))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("n") - 1) % len(weights) + 1).cast("long"))
    s = s.withColumn("top", F.col("source_size") * cap).withColumn("level", F.col("top") / F.col("w"))
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(whole),
            "before": F.coalesce(F.sum("top").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "open": F.sum("w").over(filled.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    s = s.withColumn("full", F.col("top") * F.col("open") <= (F.col("total") - F.col("before")) * F.col("w"))
    s = s.withColumns(
        {
            "spent": F.coalesce(F.sum(F.when(F.col("full"), F.col("top"))).over(whole), F.lit(0)),
            "rest": F.sum(F.when(~F.col("full"), F.col("w"))).over(whole),
        }
    )
    target = F.when(F.col("full"), F.col("top").cast("double")).otherwise(((F.col("total") - F.col("spent")) * F.col("w")).cast("double") / F.col("rest"))
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document."""
    return _mixed(docs, weights, cap).drop("th")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the number of the copy in
    a column ``copy`` (``copy_2`` and so on where the table has that name)."""
    taken = _mixed(docs, weights, cap).groupBy(F.col("doc_id").alias("taken_id"), F.col("th").alias("taken_th")).agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), row_key().alias("th")).dropDuplicates(["id", "th"])
    out = keyed.join(taken.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("taken_id")) & (F.col("th") == F.col("taken_th")))
    have = {c.lower() for c in docs.columns}
    name = next(n for n in ("copy", *(f"copy_{k}" for k in range(2, len(have) + 3))) if n not in have)
    return out.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(name))


def _mixed(docs: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    sized = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            row_key().alias("th"),
        )
    )
    salts = sized.agg(F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*")) / 100)).cast("long").alias("salts"))
    digits = F.length(F.bin("size"))
    blocks = sized.crossJoin(F.broadcast(salts)).select(
        "doc_id",
        "source",
        "size",
        "th",
        F.coalesce("source", F.lit("")).alias("name"),
        F.isnull("source").alias("unnamed"),
        (digits * 8 + F.expr("(size >> greatest(length(bin(size)) - 4, 0)) & 7")).alias("class"),
        F.coalesce(F.pmod("doc_id", "salts"), F.pmod("th", "salts")).alias("salt"),
    )
    key = ["unnamed", "name", "class", "salt"]
    ranked = blocks.withColumn("at", F.row_number().over(W.partitionBy(*key).orderBy("size", F.col("doc_id").asc_nulls_last(), "th")))
    before = W.partitionBy("unnamed", "name").orderBy("class", "salt").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.groupBy(*key).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    plan = source_targets(sized, weights, cap).select(
        F.isnull("source").alias("unnamed"),
        F.coalesce("source", F.lit("")).alias("name"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("expected"),
        (F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce("source", F.lit("")))), 1, 5), 16, 10).cast("long") / 1048576.0).alias("offset"),
    )
    placed = ranked.join(starts.drop("n").join(plan, ["unnamed", "name"]), key)
    rank = (F.col("start") + F.col("at")).cast("double")
    crossed = F.floor(rank * F.col("expected") + F.col("offset")) - F.floor((rank - 1) * F.col("expected") + F.col("offset"))
    copies = F.least(crossed, F.lit(cap)).cast("long")
    return placed.select("doc_id", "th", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([5, 2, 1][(n - 1) % 3 + 1] AS BIGINT) AS w, source_size * 3 AS top FROM per
), levelled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(top) OVER (ORDER BY top / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CAST(sum(w) OVER (ORDER BY top / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open
  FROM weighed
), judged AS (
  SELECT *, top * open <= (total - before) * w AS is_full FROM levelled
), summed AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN is_full THEN top END) OVER (), 0) AS BIGINT) AS spent, CAST(sum(CASE WHEN NOT is_full THEN w END) OVER () AS BIGINT) AS rest FROM judged
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(top AS DOUBLE) ELSE CAST((total - spent) * w AS DOUBLE) / rest END AS target,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 5) AS BIGINT) AS DOUBLE) / 1048576.0 AS off FROM summed
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS expected,
    CAST(row_number() OVER (PARTITION BY s.source ORDER BY
      length(bin(s.size)) * 8 + ((s.size >> greatest(CAST(length(bin(s.size)) AS INTEGER) - 4, 0)) & 7),
      s.doc_id % greatest(1, CAST(ceil(sqrt((SELECT count(*) FROM sized)) / 100) AS BIGINT)), s.size, s.doc_id NULLS LAST) AS DOUBLE) AS k
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, CAST(least(floor(k * expected + off) - floor((k - 1) * expected + off), 3) AS BIGINT) AS copies FROM ranked
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""
