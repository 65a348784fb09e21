"""Nearest numbers of a group, by order instead of by pairs.

Points and marks of a group are dealt to blocks of the numbers' range. Each block gets the two
last marks before it and the two first after it, and is then a window of its own. So the work
grows as sorting does, and no group, however large, is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks of the numbers' range; each group has as many at most.
BLOCKS = 64
_INF = float("inf")


def is_finite(x: str) -> Column:
    """Neither null, nor NaN, nor infinite."""
    return F.coalesce((F.col(x) < _INF) & (F.col(x) > -_INF), F.lit(False))


def least(*columns: str) -> Column:
    """The least row of an aggregate as a struct, by the columns in turn; nulls are last."""
    return F.min(F.struct(*[c for x in columns for c in (F.col(x).isNull().alias(f"no_{x}"), F.col(x))]))


def neighbours(points: DataFrame, marks: DataFrame) -> DataFrame:
    """Points (g, x, ...) with ``below`` and ``above``: the marks (g, x, key) of the same group
    next to them, as structs (x, key, behind), where behind is the place of the mark behind
    it; null if there is none. A mark at the point's own place is both. Numbers are finite,
    no two marks share (g, x)."""
    rows = marks.select("g", "x", F.struct("x", "key").alias("mark")).unionByName(points, allowMissingColumns=True)
    cuts = rows.agg(F.percentile_approx("x", [i / BLOCKS for i in range(1, BLOCKS)]).alias("cuts"))
    rows = rows.crossJoin(F.broadcast(cuts)).withColumn("block", F.size(F.filter("cuts", lambda c: c <= F.col("x")))).drop("cuts")

    own = F.array_sort(F.collect_list("mark"))
    ends = rows.groupBy("g", "block").agg(own.alias("own")).select("g", "block", F.reverse(F.slice("own", 1, 2)).alias("first"), F.when(F.size("own") > 1, F.slice("own", -2, 2)).otherwise(F.col("own")).alias("last"))
    met = lambda c, order: F.slice(F.reverse(F.flatten(F.collect_list(c).over(W.partitionBy("g").orderBy(order).rowsBetween(W.unboundedPreceding, -1)))), 1, 2)
    outer = ends.select("g", "block", F.concat(met("last", F.asc("block")), met("first", F.desc("block"))).alias("met"))
    outer = outer.select("g", "block", F.explode("met").alias("mark"))
    rows = rows.unionByName(outer.select("g", "block", "mark", F.col("mark.x").alias("x")), allowMissingColumns=True)

    def next_to(df: DataFrame, out: str, place: Column) -> DataFrame:
        # A mark comes before the points at its place, in both directions.
        w = W.partitionBy("g", "block").orderBy(place, F.col("mark").isNull()).rowsBetween(W.unboundedPreceding, -1)
        df = df.withColumn("_behind", F.last("mark.x", ignorenulls=True).over(w))
        own = F.when(F.col("mark").isNotNull(), F.struct("mark.x", "mark.key", F.col("_behind").alias("behind")))
        return df.withColumn("_own", own).withColumn(out, F.last("_own", ignorenulls=True).over(w)).drop("_own", "_behind")

    return next_to(next_to(rows, "below", F.asc("x")), "above", F.desc("x")).filter("mark IS NULL").drop("mark", "block")


def nearest_in_band(points: DataFrame, marks: DataFrame, band: int) -> DataFrame:
    """(a, v, d2, key): for each distinct point (a, v) the mark (b, w, key) that has the least
    d2 = (a - b)^2 + (v - w)^2 of those with abs(a - b) <= band; ties go by key, nulls are
    last, NaN is the largest number. A point without a mark in its band is left out."""
    points = points.select(F.col("a").cast("long").alias("a"), "v").distinct()
    marks = marks.groupBy(F.col("b").cast("long").alias("g"), F.col("w").alias("x")).agg(F.min("key").alias("key"))
    around = F.explode(F.sequence(F.col("a") - band, F.col("a") + band)).alias("g")
    d2 = lambda x: F.pow(F.col("a") - F.col("g"), F.lit(2)) + F.pow(F.col("v") - x, F.lit(2))

    # d2 never falls away from a point, so its least value is at one of the next marks. If
    # the mark behind that one is as near (numbers are rounded), the point is looked at again.
    plain = points.filter(is_finite("v")).select("a", "v", around)
    near = neighbours(plain.withColumn("x", F.col("v")), marks.filter("g IS NOT NULL").filter(is_finite("x")))
    sides = near.select("a", "v", "g", F.explode(F.array("below", "above")).alias("m")).filter("m IS NOT NULL")
    sides = sides.select("a", "v", d2(F.col("m.x")).alias("d2"), "m.key", d2(F.col("m.behind")).alias("next"))
    odd = plain.join(marks.filter(~is_finite("x")), "g").select("a", "v", d2(F.col("x")).alias("d2"), "key", F.lit(None).cast("double").alias("next"))
    found = sides.unionByName(odd).groupBy("a", "v").agg(least("d2", "key").alias("best"), F.min(F.when(F.col("next") == F.col("d2"), F.col("d2"))).alias("flat"))
    is_flat = F.coalesce(F.col("flat") == F.col("best.d2"), F.lit(False))
    done = found.filter(~is_flat).select("a", "v", "best.d2", "best.key")

    # Such points meet their whole band, and so do those that are no finite number (at most
    # four for each a; their d2 is infinite, NaN or null). Sums are hashed, no pairs are kept.
    again = found.filter(is_flat).select("a", "v", F.col("best.d2").alias("bar")).unionByName(points.filter(~is_finite("v")), allowMissingColumns=True)
    pairs = again.select("a", "v", "bar", around).join(marks, "g").withColumn("d2", d2(F.col("x")))
    key = lambda at: F.min(F.when(at, F.col("key")))
    sums = pairs.groupBy("a", "v", "bar").agg(F.min("d2").alias("d2"), key(F.col("d2") == F.col("bar")).alias("flat"), key(F.col("d2") == _INF).alias("inf"), key(F.isnan("d2")).alias("nan"), key(F.col("d2").isNull()).alias("none"))
    best = F.when(F.col("bar").isNotNull(), F.col("flat")).when(F.col("d2") == _INF, F.col("inf")).when(F.isnan("d2"), F.col("nan")).otherwise(F.col("none"))
    return done.unionByName(sums.select("a", "v", "d2", best.alias("key")))
