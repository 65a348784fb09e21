"""Retrieval quality, set measures and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recall_at(retrieved: str, expected: str, k: int) -> Column:
    """Share of the expected found among the first k; 1.0 if nothing is expected."""
    found = F.size(F.array_intersect(F.slice(retrieved, 1, k), F.array_distinct(expected)))
    return F.when(F.size(expected) == 0, 1.0).otherwise(found / F.greatest(F.size(F.array_distinct(expected)), F.lit(1)))


def precision_at(retrieved: str, expected: str, k: int) -> Column:
    return F.size(F.filter(F.slice(retrieved, 1, k), lambda x: F.array_contains(F.col(expected), x))) / F.lit(float(k))


def reciprocal_rank(retrieved: str, expected: str) -> Column:
    """1 / the first relevant rank; 0 without one, 1.0 if nothing is expected."""
    ranks = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(F.col(expected), x), i + 1)), lambda r: r.isNotNull())
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0)))


def metric_means(items: DataFrame, *by: str) -> DataFrame:
    """Means of the metrics over rows without an error; rows with one count in total."""
    ok = F.col("error").isNull()
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    # The value at place floor(0.95 n) + 1: just above 0.95 of the values. Partial counts of
    # distinct values are merged, no list of all.
    p95 = F.expr("percentile_disc(0.950000001) WITHIN GROUP (ORDER BY latency) FILTER (WHERE error IS NULL)")
    cols = [F.count("*").alias("total"), F.count_if(~ok).alias("failed"), mean("r1").alias("r1"), mean("r3").alias("r3"), mean("r5").alias("r5"), mean("p5").alias("p5"), mean("mrr").alias("mrr"), mean("latency").alias("avg_latency"), p95.alias("p95_latency")]
    return (items.rollup(*by) if by else items.groupBy()).agg(*cols)


def scorecard(cases: DataFrame, category: str = "category") -> DataFrame:
    """Passed / total in percent, by category and overall."""
    g = cases.rollup(category).agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    return g.withColumn("pct", 100.0 * F.col("passed") / F.col("total")).withColumn(category, F.coalesce(category, F.lit("overall")))


def linear_score(ratio: Column, weight: float = 100.0) -> Column:
    """max(0, int(100 - ratio * weight))."""
    return F.greatest(F.lit(0), (100.0 - ratio * weight).cast("int"))


def percent_text(n: Column, total: Column) -> Column:
    return F.format_string("%.1f%%", 100.0 * n / F.greatest(total, F.lit(1)))


def spacing_ratio(text: str) -> Column:
    """Spaces over all characters."""
    spaces = F.length(text) - F.length(F.replace(F.col(text), F.lit(" "), F.lit("")))
    return spaces / (F.length(text) + 1)


def words_of(text: Column, least: int) -> Column:
    """Distinct lower-case words of at least so many characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least))


def overlap_share(a: Column, b: Column) -> Column:
    """|a and b| / |b|, 1.0 if b is empty."""
    return F.when(F.size(b) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(b), F.lit(1)))


def best_covered(items: DataFrame, docs: DataFrame, item: str, doc: str, k: int) -> DataFrame:
    """(item, doc, share, rank): of each item (item, bw: distinct words) the k documents
    (doc, dw: distinct words) that have the largest share of its words; ties go by doc.
    Documents that share no word are in no answer, except for an item without words, which
    all cover. Words meet by a join, so only pairs with a word in common are counted."""
    w = W.partitionBy(item).orderBy(F.desc("share"), doc)
    asked = items.filter(F.size("bw") > 0).select(item, F.size("bw").alias("n"), F.explode("bw").alias("word"))
    met = docs.select(doc, F.explode("dw").alias("word")).join(asked, "word").groupBy(item, doc, "n").agg(F.count("*").alias("c"))
    scored = met.select(item, doc, F.round(F.col("c") / F.col("n"), 6).alias("share"))
    first = docs.select(doc).orderBy(doc).limit(k).withColumn("bare", F.lit(True))
    bare = items.filter(F.size("bw") == 0).select(item, F.lit(True).alias("bare")).join(first, "bare").select(item, doc, F.lit(1.0).alias("share"))
    return scored.unionByName(bare).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def even_sample(pages: DataFrame, doc: str, page: str, rate: float = 0.3) -> DataFrame:
    """Every step-th page after the first, n = clamp(floor(rate * pages), 2, 5) of them."""
    total = F.count("*").over(W.partitionBy(doc))
    n = F.greatest(F.lit(2), F.least(F.lit(5), F.floor(rate * total)))
    step = F.greatest(F.lit(1), F.floor((total - 1) / n))
    at = F.row_number().over(W.partitionBy(doc).orderBy(page)) - 1
    s = pages.withColumns({"_at": at, "_n": n, "_step": step})
    return s.filter((F.col("_at") >= 1) & (F.pmod(F.col("_at") - 1, F.col("_step")) == 0) & (F.floor((F.col("_at") - 1) / F.col("_step")) < F.col("_n"))).drop("_at", "_n", "_step")


def missing_in_range(rows: DataFrame, key: str, n: str) -> DataFrame:
    """Numbers between a key's least and greatest that do not occur: how many, the first and
    the last. Gaps are counted from neighbours, so one wild number costs nothing."""
    nxt = rows.select(key, F.col(n).alias("n"), F.lead(n).over(W.partitionBy(key).orderBy(n)).alias("next")).filter("next - n > 1")
    return nxt.groupBy(key).agg(F.sum(F.col("next") - F.col("n") - 1).cast("int").alias("n_gaps"), F.min(F.col("n") + 1).alias("first_gap"), F.max(F.col("next") - 1).alias("last_gap"))


def numbered_within(rows: DataFrame, group: str, order: str, out: str, blocks: int = 200) -> DataFrame:
    """Numbers from 0 within a group by a numeric order. Rows are ranked within blocks of the
    order's range, and a block starts after those before it; so no group, however large, is
    one task's."""
    span = rows.agg(F.min(order).alias("lo"), F.greatest(F.lit(1), F.ceil((F.max(order) - F.min(order) + 1) / blocks)).alias("width"))
    r = rows.crossJoin(F.broadcast(span)).withColumn("block", F.coalesce(F.floor((F.col(order) - F.col("lo")) / F.col("width")), F.lit(-1))).drop("lo", "width")
    before = W.partitionBy(group).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = r.groupBy(group, "block").agg(F.count("*").alias("k")).select(F.col(group).alias("of"), F.col("block").alias("in"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    ranked = r.withColumn(out, F.row_number().over(W.partitionBy(group, "block").orderBy(order)) - 1)
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col("of")) & (F.col("block") == F.col("in")))
    return joined.withColumn(out, F.col(out) + F.col("start")).select(*rows.columns, out)


def grid_argmax(axes: dict[str, DataFrame], score: Column) -> DataFrame:
    """The best point of a small grid (the axes are parameter lists)."""
    grid = None
    for name, df in axes.items():
        part = F.broadcast(df.select(name))
        grid = part if grid is None else grid.join(part)
    names = sorted(axes)
    return grid.withColumn("score", score).orderBy(F.desc("score"), *names).limit(1)
