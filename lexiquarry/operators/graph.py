"""Relationship graphs: nodes (id, ...), edges (src, rel, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.session import scratch_dir


def exploded_edges(docs: DataFrame, relations: dict[str, str]) -> DataFrame:
    """Edges from array columns: relation name to column; no self or double edges."""
    parts = [docs.select(F.col("id").alias("src"), F.lit(rel).alias("rel"), F.explode(col).alias("dst")) for rel, col in relations.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("src != dst").dropDuplicates(["src", "rel", "dst"])


def status_after(nodes: DataFrame, edges: DataFrame, amend_policy: str = "KEEP") -> DataFrame:
    """Targets of REPLACES are SUPERSEDED, of AMENDS OUTDATED unless kept."""
    hit = edges.filter(F.col("rel").isin("REPLACES", "AMENDS")).groupBy(F.col("dst").alias("id")).agg(F.bool_or(F.col("rel") == "REPLACES").alias("replaced"))
    out = nodes.join(hit, "id", "left")
    amended = F.lit("OUTDATED") if amend_policy == "OUTDATED" else F.col("status")
    return out.withColumn("status", F.when(F.col("replaced"), "SUPERSEDED").when(F.col("replaced").isNotNull(), amended).otherwise(F.col("status"))).drop("replaced")


def neighbours(nodes: DataFrame, edges: DataFrame, start: int | str) -> DataFrame:
    """Both directions, one hop."""
    both = edges.select("src", "rel", "dst").unionByName(edges.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst")))
    return both.filter(F.col("src") == F.lit(start)).join(nodes.withColumnRenamed("id", "dst"), "dst").select("dst", "rel").distinct()


def reachable(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, id, depth): the least number of hops to each node, breadth first, up to
    ``hops``. Each round is a table of its own, joined to the edges and held against the
    rounds before; so a round's plan is as long as the first one's, and a lost executor
    costs one round. Ends early when a round finds nothing."""
    spark = edges.sparkSession
    path = scratch_dir(spark)
    edges.select("src", "dst").distinct().write.parquet(f"{path}/edges")
    step = spark.read.parquet(f"{path}/edges")
    schema = f"start {starts.schema['id'].dataType.simpleString()}, id {step.schema['dst'].dataType.simpleString()}, depth int"
    levels = lambda: spark.read.schema(schema).parquet(f"{path}/levels")
    starts.select(F.col("id").alias("start"), "id").distinct().write.parquet(f"{path}/levels/depth=0")
    for k in range(1, hops + 1):
        seen = levels()
        frontier = seen.filter(F.col("depth") == k - 1).select("start", F.col("id").alias("src"))
        found = frontier.join(step, "src").select("start", F.col("dst").alias("id")).distinct()
        found.join(seen.select("start", "id"), ["start", "id"], "left_anti").write.parquet(f"{path}/levels/depth={k}")
        if not levels().filter(F.col("depth") == k).limit(1).count():
            break
    return levels()


def longest_chain(edges: DataFrame, starts: DataFrame, hops: int = 10) -> DataFrame:
    """(start, path, rels): from each start the longest path of distinct nodes, up to
    ``hops``; of equal ones the least. ``edges`` may have a column ``rel``. Paths are
    found by recursive SQL, whose plan does not grow with the hops."""
    spark = edges.sparkSession
    steps = edges.select("src", "dst", (F.col("rel") if "rel" in edges.columns else F.lit("")).alias("rel")).groupBy("src", "dst").agg(F.min("rel").alias("rel"))
    node = steps.schema["dst"].dataType.simpleString()
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(
        f"""
        WITH RECURSIVE paths(start, tip, path, rels, hops) AS (
          SELECT CAST(id AS {node}), CAST(id AS {node}), array(CAST(id AS {node})), CAST(array() AS array<string>), 0 FROM {{starts}}
          UNION ALL
          SELECT p.start, s.dst, concat(p.path, array(s.dst)), concat(p.rels, array(s.rel)), p.hops + 1
          FROM paths p JOIN {{steps}} s ON s.src = p.tip
          WHERE p.hops < {hops} AND NOT array_contains(p.path, s.dst)
        )
        SELECT start, best.path AS path, best.rels AS rels
        FROM (SELECT start, min_by(struct(path, rels), struct(-hops, path)) AS best FROM paths GROUP BY start)
        """,
        starts=starts.select("id").distinct(),
        steps=steps,
    )


#: Sections of a timeline in their order: direction and relation of one-hop edges.
_SECTIONS = (("in", "REPLACES", 1), ("in", "PROMULGATES", 2), ("in", "AMENDS", 3), ("out", "PROMULGATES", 5), ("out", "AMENDS", 6), ("in", "GOVERNS_TRANSITIONAL", 8), ("out", "GOVERNS_TRANSITIONAL", 9))


def timeline(nodes: DataFrame, edges: DataFrame, starts: DataFrame, hops: int = 10) -> DataFrame:
    """The timeline of each start: what replaces it (section 1), promulgates (2) and amends it
    (3), itself (4), what it promulgates (5) and amends (6), the longest chain of what it replaces
    or refers to (7), and what governs it (8) or is governed by it (9) in a transition.

    nodes (id, number, effective_date, status), edges (src, rel, dst, cutoff_date,
    grace_period_end, condition), starts (id). Rows: start, section, ord, id, number,
    effective_date, status, relation_to_next and the edge's properties. ``ord`` counts the
    chain's nodes in section 7 and goes by id elsewhere. A start without a node has no rows."""
    edges = edges.dropDuplicates(["src", "rel", "dst"])
    start = starts.select(F.col("id").alias("start")).distinct().join(nodes.select(F.col("id").alias("start")), "start", "left_semi")
    props = ["cutoff_date", "grace_period_end", "condition"]
    # Every edge at a start, once for each end, with its section.
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("start"), F.lit("in").alias("way"), F.col("src").alias("id")), F.struct(F.col("src").alias("start"), F.lit("out").alias("way"), F.col("dst").alias("id")))).alias("e"), "rel", *props)
    near = ends.select("e.start", "e.way", "e.id", "rel", *props).join(start, "start")
    section = F.coalesce(*[F.when((F.col("way") == w) & (F.col("rel") == rel), F.lit(n)) for w, rel, n in _SECTIONS])
    told = F.when(F.col("section").isin(1, 2, 3, 8), F.col("rel")).when(F.col("section") == 9, "TRANSITIONAL_PREDECESSOR")
    none = [F.when(F.col("section") >= 8, F.col(c)).alias(c) for c in props]
    order = W.partitionBy("start", "section").orderBy("id")
    around = near.withColumn("section", section).filter("section IS NOT NULL").select("start", "section", F.row_number().over(order).alias("ord"), "id", told.alias("relation_to_next"), *none)

    chain = longest_chain(edges.filter(F.col("rel").isin("REPLACES", "REFERENCES")), start.select(F.col("start").alias("id")), hops)
    empty = [F.lit(None).cast("string").alias(c) for c in props]
    steps = chain.select("start", "rels", F.posexplode("path").alias("ord", "id"))
    below = steps.filter("ord > 0").select("start", F.lit(7).alias("section"), "ord", "id", F.get("rels", F.col("ord")).alias("relation_to_next"), *empty)
    first = near.groupBy("start").agg(*[F.bool_or((F.col("way") == "out") & (F.col("rel") == rel)).alias(rel) for rel in ("PROMULGATES", "AMENDS")])
    own = chain.select("start", F.get("rels", F.lit(0)).alias("along")).join(first, "start", "left")
    own = own.select("start", F.lit(4).alias("section"), F.lit(1).alias("ord"), F.col("start").alias("id"), F.when(F.col("PROMULGATES"), "PROMULGATES").when(F.col("AMENDS"), "AMENDS").otherwise(F.col("along")).alias("relation_to_next"), *empty)

    rows = around.unionByName(below).unionByName(own).join(nodes, "id")
    unknown = F.when(F.col("section") == 4, "UNKNOWN").when(F.col("section").isin(7, 9), "OUTDATED").otherwise("ACTIVE")
    return rows.select("start", "section", "ord", "id", F.coalesce("number", F.col("id").cast("string")).alias("number"), F.coalesce("effective_date", F.lit("unknown")).alias("effective_date"), F.coalesce("status", unknown).alias("status"), "relation_to_next", *props)


def repaired_numbers(nodes: DataFrame) -> DataFrame:
    """Empty numbers filled from the id without its prefix."""
    empty = F.col("number").isNull() | F.lower("number").isin("", "unknown")
    return nodes.withColumn("number", F.when(empty, F.regexp_replace("id", "^[^:]*::", "")).otherwise(F.col("number")))
