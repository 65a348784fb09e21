"""Connected components over a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a, b) of any comparable type. Returns (k, label), the least member of each
    member's component. Each round every node takes the least label among its own, its
    neighbours' and its label's label; rounds end when none changes, after about as many
    rounds as the logarithm of a component's diameter."""
    edges = stored(links.select(F.col("a").alias("k"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("k"), F.col("a").alias("other"))).filter("k != other").distinct())
    labels = stored(edges.groupBy("k").agg(F.min("other").alias("label")).select("k", F.least("k", "label").alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("k", "other"), "other").select("k", "label")
        jump = labels.select("k", F.col("label").alias("via")).join(labels.select(F.col("k").alias("via"), "label"), "via").select("k", "label")
        best = labels.unionByName(near).unionByName(jump).groupBy("k").agg(F.min("label").alias("label"))
        new = stored(best.join(labels.withColumnRenamed("label", "old"), "k").select("k", "label", "old"))
        changed = new.filter("label != old").limit(1).count()
        labels = new.select("k", "label")
        if not changed:
            return labels
