"""Rules and graphs bound to the tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.operators import graph as g
from lexiquarry.operators import rules as r
from lexiquarry.plans.registry import Registry
from lexiquarry.session import table

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

_GRADES = "(ARRAY['I','II','III','IV','V'])"
_BUILD = "b AS (SELECT p_partkey, ['I','II','III','IV','V'][p_partkey % 5 + 1] AS grade, p_size % 2 = 0 AS spr, p_size % 3 <> 0 AS no_attic, p_size % 5 < 3 AS alarm, CASE p_partkey % 3 WHEN 0 THEN 'A' ELSE 'B' END AS wall, CASE p_partkey % 4 WHEN 0 THEN 'B1' ELSE 'B2' END AS flo FROM part)"
_RATE = "t AS (" + " UNION ALL ".join(f"SELECT '{gr}' AS grade, '{e}' AS element, '{v}' AS base_rei" for gr, vs in r.RATINGS.items() for e, v in zip(r.ELEMENTS, vs, strict=True)) + ")"
_DOWN = "CASE base_rei " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in r.STEP_DOWN.items()) + " ELSE base_rei END"
_FINAL = f"""CASE WHEN base_rei = '{r.UNREGULATED}' THEN base_rei WHEN spr AND no_attic AND element = 'roof' THEN 'RE 15' WHEN spr AND no_attic AND element = 'truss_beam_purlin' THEN 'R 15'
 WHEN alarm AND wall = 'A' AND element = 'wall_inner' OR spr AND flo = 'B1' AND element = 'floor' THEN {_DOWN} ELSE base_rei END"""


def buildings(spark, d):
    p = table(spark, d, "part")
    grades = F.array(*[F.lit(x) for x in r.RATINGS])
    return p.select(
        "p_partkey",
        F.element_at(grades, (F.col("p_partkey") % 5 + 1).cast("int")).alias("grade"),
        (F.col("p_size") % 2 == 0).alias("has_sprinkler"),
        (F.col("p_size") % 3 != 0).alias("no_attic"),
        (F.col("p_size") % 5 < 3).alias("has_auto_alarm"),
        F.when(F.col("p_partkey") % 3 == 0, "A").otherwise("B").alias("wall_group"),
        F.when(F.col("p_partkey") % 4 == 0, "B1").otherwise("B2").alias("floor_group"),
    )


@reg("ru3_element_rating", f"WITH {_BUILD}, {_RATE} SELECT p_partkey, element, base_rei, {_FINAL} AS final_rei FROM (SELECT *, ['load_bearing_wall','column','floor','roof','truss_beam_purlin','wall_inner','staircase'][p_partkey % 7 + 1] AS element FROM b) JOIN t USING (grade, element)")
def ru3(spark, d):
    e = F.element_at(F.array(*[F.lit(x) for x in r.ELEMENTS]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return r.element_ratings(buildings(spark, d).withColumn("element", e)).select("p_partkey", "element", "base_rei", "final_rei")


@reg("ru4_all_elements", f"WITH {_BUILD}, {_RATE} SELECT p_partkey, element, base_rei, {_FINAL} AS final_rei FROM b JOIN t USING (grade)")
def ru4(spark, d):
    return r.all_elements(buildings(spark, d)).select("p_partkey", "element", "base_rei", "final_rei")


def _flow(v: str) -> str:
    n = " + ".join(f"CASE WHEN {v} > {u} THEN 1 ELSE 0 END" for u in r.FLOW_VOLUMES)
    return f"(CASE WHEN haz IN ('A','B','C') THEN 20.0 + 10.0 * ({n}) ELSE 10.0 + 5.0 * ({n}) END)"


@reg("ru5_water_flow", f"WITH x AS (SELECT p_partkey, 20000.0 * (p_partkey % 50 + 1) AS vol, ['A','B','C','D','E'][p_partkey % 5 + 1] AS haz, 2.0 * p_size AS height, p_partkey % 2 = 0 AS split, 9000.0 * (p_partkey % 40 + 1) AS c1, 7000.0 * (p_partkey % 60 + 1) AS c2 FROM part), y AS (SELECT *, greatest(c1, c2) AS hi, least(c1, c2) AS lo FROM x), z AS (SELECT p_partkey, height, CASE WHEN split THEN {_flow('hi')} + 0.5 * {_flow('lo')} ELSE {_flow('vol')} END AS base_flow FROM y) SELECT p_partkey, CAST(base_flow AS DOUBLE) AS base_flow, CAST(CASE WHEN height >= 50 THEN base_flow * 1.5 ELSE base_flow END AS DOUBLE) AS flow FROM z")
def ru5(spark, d):
    p = table(spark, d, "part")
    x = p.select(
        "p_partkey",
        (20000.0 * (F.col("p_partkey") % 50 + 1)).alias("volume"),
        F.element_at(F.array(*[F.lit(c) for c in "ABCDE"]), (F.col("p_partkey") % 5 + 1).cast("int")).alias("hazard"),
        (2.0 * F.col("p_size")).alias("height"),
        F.when(F.col("p_partkey") % 2 == 0, F.array(9000.0 * (F.col("p_partkey") % 40 + 1), 7000.0 * (F.col("p_partkey") % 60 + 1))).alias("compartments"),
    )
    return r.water_flow(x).select("p_partkey", "base_flow", "flow")


_PROJ = "p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'Kho đạn ' ELSE 'Tower ' END || o_orderkey AS name, ['DAC_BIET','I','II','III','IV'][o_orderkey % 5 + 1] AS level, CASE WHEN o_orderkey % 2 = 0 THEN 'F1.2' ELSE 'F4.3' END AS fun, 100 + o_custkey % 80 AS height, o_custkey % 6 AS basements, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS pccc, CAST(o_orderdate AS DATE) + 365 AS permit FROM orders)"


def projects(spark, d):
    o = table(spark, d, "orders")
    p = o.select(
        "o_orderkey",
        F.concat(F.when(F.col("o_orderkey") % 11 == 0, "Kho đạn ").otherwise("Tower "), F.col("o_orderkey").cast("string")).alias("name"),
        F.element_at(F.array(*[F.lit(x) for x in ("DAC_BIET", "I", "II", "III", "IV")]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("level"),
        F.when(F.col("o_orderkey") % 2 == 0, "F1.2").otherwise("F4.3").alias("function"),
        F.lit(False).alias("is_apartment"),
        (100 + F.col("o_custkey") % 80).alias("height"),
        (F.col("o_custkey") % 6).alias("basements"),
        F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate")).alias("pccc"),
        F.date_add(F.to_date("o_orderdate"), 365).alias("permit"),
    )
    return p.withColumn("anchor", r.anchor_date(F.col("pccc"), F.col("permit"), F.lit(None).cast("date"), F.lit(None).cast("date")))


@reg("ru9_anchor_date", f"WITH {_PROJ} SELECT o_orderkey, coalesce(pccc, permit) AS anchor FROM p")
def ru9(spark, d):
    return projects(spark, d).select("o_orderkey", "anchor")


@reg("ru1_scope_gate", f"""WITH {_PROJ}, q AS (SELECT *, coalesce(pccc, permit) AS anchor, name LIKE 'Kho đạn%' AS bad, fun = 'F1.2' AS apt FROM p)
 SELECT o_orderkey, NOT bad AS applicable, NOT bad AND apt AND (height > 150 OR basements > 3) AS special_clearance, CASE WHEN bad THEN NULL WHEN apt AND level <> 'IV' THEN 'QCVN 06,QCVN 04' ELSE 'QCVN 06' END AS codes,
 CASE WHEN anchor < DATE '1997-01-01' THEN 'original' ELSE 'amended' END AS edition_06, CASE WHEN NOT bad AND apt AND level <> 'IV' THEN CASE WHEN anchor < DATE '1999-01-01' THEN 'original' ELSE 'amended' END END AS edition_04, 'LAW_2014' AS era FROM q""")
def ru1(spark, d):
    s = r.scope_gate(projects(spark, d), "1997-01-01", "1999-01-01")
    return s.select("o_orderkey", "applicable", "special_clearance", F.array_join("codes", ",").alias("codes"), "edition_06", "edition_04", "era")


@reg("pf17_excluded_facility", f"WITH {_PROJ} SELECT o_orderkey, 'kho đạn' AS word FROM p WHERE name LIKE 'Kho đạn%'")
def pf17(spark, d):
    return projects(spark, d).select("o_orderkey", r.excluded_word(F.col("name")).alias("word")).filter("word IS NOT NULL")


_EDITIONS = "f AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS valid_from FROM orders WHERE o_orderkey % 50 = 0), e AS (SELECT 'e' || valid_from AS edition, valid_from, lead(valid_from) OVER (ORDER BY valid_from) AS valid_to FROM f)"


@reg("jn12_edition_by_date", f"WITH {_EDITIONS} SELECT o_orderkey, edition FROM orders LEFT JOIN e ON CAST(o_orderdate AS DATE) >= valid_from AND (valid_to IS NULL OR CAST(o_orderdate AS DATE) < valid_to)")
def jn12(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    e = o.filter("o_orderkey % 50 = 0").select(F.col("day").alias("valid_from")).distinct()  # a row for each day
    e = e.select(F.concat(F.lit("e"), F.col("valid_from").cast("string")).alias("edition"), "valid_from", F.lead("valid_from").over(W.partitionBy(F.lit(0)).orderBy("valid_from")).alias("valid_to"))
    return r.edition_at(o, "o_orderkey", "day", e).select("o_orderkey", "edition")


_EV = "x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'basement' WHEN 1 THEN 'semi_basement' ELSE 'outdoor' END IN ('basement', 'semi_basement') AS base, p_size AS cars, p_size * 2 AS motos, 40.0 * p_size AS area, p_partkey % 2 = 0 AS wall, p_partkey % 9 AS space, p_partkey % 7 < 6 AS alarm, 7.0 + p_partkey % 20 AS power FROM part)"


@reg("ru6_charging_area", f"""WITH {_EV}, f AS (SELECT p_partkey, list_concat(CASE WHEN base THEN [cars <= 25, motos <= 50, area <= CASE WHEN cars > 0 THEN 1200 ELSE 300 END] ELSE [] END, [wall OR space >= 6, alarm], CASE WHEN base THEN [power <= 22] ELSE [] END) AS f FROM x)
 SELECT p_partkey, len(f) AS n_findings, len(list_filter(f, lambda y: NOT y)) AS n_failed, CASE WHEN list_contains(f, false) THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END AS status FROM f""")
def ru6(spark, d):
    p = table(spark, d, "part")
    x = p.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, "basement").when(F.col("p_partkey") % 3 == 1, "semi_basement").otherwise("outdoor").alias("location"),
        F.col("p_size").alias("car_spots"),
        (F.col("p_size") * 2).alias("moto_spots"),
        (40.0 * F.col("p_size")).alias("area"),
        (F.col("p_partkey") % 2 == 0).alias("fire_wall"),
        (F.col("p_partkey") % 9).alias("open_space"),
        F.lit(False).alias("drencher"),
        F.lit(0.0).alias("drencher_flow"),
        (F.col("p_partkey") % 7 < 6).alias("alarm"),
        *[F.lit(True).alias(c) for c in ("sprinkler", "smoke", "gas")],
        (7.0 + F.col("p_partkey") % 20).alias("power"),
        F.lit(None).cast("date").alias("pccc"),
    )
    c = r.charging_findings(x)
    return c.select("p_partkey", F.size("findings").cast("long").alias("n_findings"), F.size(F.filter("findings", lambda y: ~y["passed"])).cast("long").alias("n_failed"), "status")


@reg("ru7_compliance_status", f"WITH {_PROJ} SELECT o_orderkey, CASE WHEN name LIKE 'Kho đạn%' THEN 'NON_COMPLIANT' WHEN fun = 'F1.2' AND (height > 150 OR basements > 3) THEN 'CONDITIONAL' ELSE 'COMPLIANT' END AS status FROM p")
def ru7(spark, d):
    s = r.scope_gate(projects(spark, d), "1997-01-01", "1999-01-01")
    return s.select("o_orderkey", r.overall_status(~F.col("applicable"), F.col("special_clearance")).alias("status"))


@reg("ru10_assessment_text", f"WITH {_PROJ} SELECT o_orderkey, '# ' || name || chr(10) || 'height: ' || height || chr(10) || 'basements: ' || basements AS text FROM p")
def ru10(spark, d):
    p = projects(spark, d)
    lines = F.array(F.concat(F.lit("# "), "name"), F.concat(F.lit("height: "), F.col("height").cast("string")), F.concat(F.lit("basements: "), F.col("basements").cast("string")))
    return p.select("o_orderkey", F.array_join(lines, "\n").alias("text"))


# Graphs: events are nodes; each links the one before and the third before of its user.
_EDGE = "edges AS (SELECT DISTINCT src, rel, dst FROM (SELECT unnest([lag(event_id) OVER w, lag(event_id, 3) OVER w]) AS src, CASE event_type WHEN 'click' THEN 'REPLACES' WHEN 'view' THEN 'AMENDS' ELSE 'REFERENCES' END AS rel, event_id AS dst FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE src IS NOT NULL AND src <> dst)"


def edges(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rel = F.when(F.col("event_type") == "click", "REPLACES").when(F.col("event_type") == "view", "AMENDS").otherwise("REFERENCES")
    both = F.array(F.lag("event_id").over(w), F.lag("event_id", 3).over(w))
    e = table(spark, d, "events").select(both.alias("both"), rel.alias("rel"), F.col("event_id").alias("dst"))
    return e.select(F.explode("both").alias("src"), "rel", "dst").filter("src IS NOT NULL AND src != dst").distinct()


@reg("sk7_edge_merge", f"WITH {_EDGE} SELECT * FROM edges")
def sk7(spark, d):
    docs = edges(spark, d).groupBy(F.col("src").alias("id")).agg(*[F.collect_list(F.when(F.col("rel") == x, F.col("dst"))).alias(x.lower()) for x in ("REPLACES", "AMENDS", "REFERENCES")])
    return g.exploded_edges(docs, {x: x.lower() for x in ("REPLACES", "AMENDS", "REFERENCES")})


@reg("sk8_topology_status", f"WITH {_EDGE}, n AS (SELECT event_id AS id FROM events) SELECT id, CASE WHEN id IN (SELECT dst FROM edges WHERE rel = 'REPLACES') THEN 'SUPERSEDED' WHEN id IN (SELECT dst FROM edges WHERE rel = 'AMENDS') THEN 'OUTDATED' ELSE 'ACTIVE' END AS status FROM n")
def sk8(spark, d):
    n = table(spark, d, "events").select(F.col("event_id").alias("id")).withColumn("status", F.lit("ACTIVE"))
    return g.status_after(n, edges(spark, d), "OUTDATED").select("id", "status")


@reg("sk8_topology_counts", f"WITH {_EDGE} SELECT rel, count(*) AS n FROM edges GROUP BY 1")
def sk8_counts(spark, d):
    return edges(spark, d).groupBy("rel").agg(F.count("*").alias("n"))


@reg("jn8_graph_neighbours", f"WITH {_EDGE} SELECT DISTINCT dst, rel FROM (SELECT src, rel, dst FROM edges UNION ALL SELECT dst, rel, src FROM edges) WHERE src = 7")
def jn8(spark, d):
    n = table(spark, d, "events").select(F.col("event_id").alias("id"))
    return g.neighbours(n, edges(spark, d), 7)


_STARTS = "(SELECT event_id AS id FROM events WHERE event_id % 20 = 7)"
_REACH = "r(start, id, depth) AS (SELECT id, id, 0 FROM {1} UNION SELECT start, e.dst, depth + 1 FROM r JOIN {2} e ON e.src = r.id WHERE depth < {0})"


def starts(spark, d):
    """The nodes that are asked about."""
    return table(spark, d, "events").filter("event_id % 20 = 7").select(F.col("event_id").alias("id"))


@reg("vg7_variable_length_relations", f"WITH RECURSIVE {_EDGE}, {_REACH.format(10, _STARTS, 'edges')} SELECT start, id, min(depth) AS depth FROM r GROUP BY 1, 2")
def vg7(spark, d):
    return g.reachable(edges(spark, d), starts(spark, d), 10)


@reg("vg8_guided_documents", f"WITH RECURSIVE {_EDGE}, rev AS (SELECT dst AS src, src AS dst FROM edges WHERE rel = 'AMENDS'), {_REACH.format(2, _STARTS, 'rev')} SELECT start, id, min(depth) AS depth FROM r GROUP BY 1, 2")
def vg8(spark, d):
    back = edges(spark, d).filter("rel = 'AMENDS'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return g.reachable(back, starts(spark, d), 2)


# For timelines an edge's relation is that of its newer event; half of the nodes lack a date or status.
_KINDS = {"click": "REPLACES", "view": "AMENDS", "purchase": "PROMULGATES", "signup": "GOVERNS_TRANSITIONAL"}
_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " ELSE 'REFERENCES' END"
_LAW = f"""law AS (SELECT DISTINCT src, rel, dst, day AS cutoff_date, '+' || day AS grace_period_end, CASE WHEN dst % 3 = 0 THEN 'if ' || dst END AS condition FROM (SELECT unnest([lag(event_id) OVER w, lag(event_id, 3) OVER w]) AS src, {_KIND} AS rel, event_id AS dst, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE src IS NOT NULL AND src <> dst),
 node AS (SELECT event_id AS id, CASE WHEN event_id % 5 > 0 THEN 'n' || event_id END AS number, CASE WHEN event_id % 2 = 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS effective_date, CASE WHEN event_id % 4 = 0 THEN 'DRAFT' END AS status FROM events)"""
_TIMELINE = f"""WITH RECURSIVE {_LAW}, s AS {_STARTS}, c AS (SELECT src, dst, min(rel) AS rel FROM law WHERE rel IN ('REPLACES', 'REFERENCES') GROUP BY 1, 2),
 p(start, tip, path, rels) AS (SELECT id, id, [id], CAST([] AS VARCHAR[]) FROM s UNION ALL SELECT start, c.dst, list_append(path, c.dst), list_append(rels, c.rel) FROM p JOIN c ON c.src = tip WHERE len(path) <= 10 AND NOT list_contains(path, c.dst)),
 best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY start ORDER BY len(path) DESC, path) = 1),
 near AS (SELECT dst AS start, 'in' AS way, src AS id, rel, cutoff_date, grace_period_end, condition FROM law UNION ALL SELECT src, 'out', dst, rel, cutoff_date, grace_period_end, condition FROM law),
 numbered AS (SELECT near.*, CASE WHEN way = 'in' THEN CASE rel WHEN 'REPLACES' THEN 1 WHEN 'PROMULGATES' THEN 2 WHEN 'AMENDS' THEN 3 WHEN 'GOVERNS_TRANSITIONAL' THEN 8 END ELSE CASE rel WHEN 'PROMULGATES' THEN 5 WHEN 'AMENDS' THEN 6 WHEN 'GOVERNS_TRANSITIONAL' THEN 9 END END AS section FROM near JOIN s ON s.id = near.start),
 every AS (
  SELECT start, section, CAST(row_number() OVER (PARTITION BY start, section ORDER BY id) AS INTEGER) AS ord, id, CASE WHEN section IN (1, 2, 3, 8) THEN rel WHEN section = 9 THEN 'TRANSITIONAL_PREDECESSOR' END AS relation_to_next,
   CASE WHEN section >= 8 THEN cutoff_date END AS cutoff_date, CASE WHEN section >= 8 THEN grace_period_end END AS grace_period_end, CASE WHEN section >= 8 THEN condition END AS condition FROM numbered WHERE section IS NOT NULL
  UNION ALL SELECT start, 7, CAST(i AS INTEGER), path[i + 1], rels[i + 1], NULL, NULL, NULL FROM (SELECT start, path, rels, unnest(range(1, len(path))) AS i FROM best)
  UNION ALL SELECT b.start, 4, 1, b.start, CASE WHEN o.p THEN 'PROMULGATES' WHEN o.a THEN 'AMENDS' ELSE b.rels[1] END, NULL, NULL, NULL FROM best b LEFT JOIN (SELECT start, bool_or(way = 'out' AND rel = 'PROMULGATES') AS p, bool_or(way = 'out' AND rel = 'AMENDS') AS a FROM numbered GROUP BY 1) o ON o.start = b.start)
 SELECT e.start, e.section, e.ord, e.id, coalesce(n.number, CAST(e.id AS VARCHAR)) AS number, coalesce(n.effective_date, 'unknown') AS effective_date, coalesce(n.status, CASE WHEN section = 4 THEN 'UNKNOWN' WHEN section IN (7, 9) THEN 'OUTDATED' ELSE 'ACTIVE' END) AS status, e.relation_to_next, e.cutoff_date, e.grace_period_end, e.condition FROM every e JOIN node n ON n.id = e.id"""


def law_edges(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    day = F.to_date("ts").cast("string")
    e = table(spark, d, "events").select(F.array(F.lag("event_id").over(w), F.lag("event_id", 3).over(w)).alias("both"), F.coalesce(F.try_element_at(kinds, "event_type"), F.lit("REFERENCES")).alias("rel"), F.col("event_id").alias("dst"), day.alias("cutoff_date"))
    e = e.select(F.explode("both").alias("src"), "rel", "dst", "cutoff_date").filter("src IS NOT NULL AND src != dst")
    return e.withColumns({"grace_period_end": F.concat(F.lit("+"), "cutoff_date"), "condition": F.when(F.col("dst") % 3 == 0, F.concat(F.lit("if "), F.col("dst").cast("string")))})


def law_nodes(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(i.alias("id"), F.when(i % 5 > 0, F.concat(F.lit("n"), i.cast("string"))).alias("number"), F.when(i % 2 == 0, F.to_date("ts").cast("string")).alias("effective_date"), F.when(i % 4 == 0, "DRAFT").alias("status"))


@reg("vg5_legal_timeline", _TIMELINE)
def vg5(spark, d):
    return g.timeline(law_nodes(spark, d), law_edges(spark, d), starts(spark, d), 10)


@reg("vg5_longest_timeline", f"WITH RECURSIVE {_EDGE}, c AS (SELECT DISTINCT src, dst FROM edges WHERE rel = 'REPLACES'), p(start, tip, path) AS (SELECT id, id, [id] FROM {_STARTS} UNION ALL SELECT start, c.dst, list_append(path, c.dst) FROM p JOIN c ON c.src = tip WHERE len(path) <= 10 AND NOT list_contains(path, c.dst)) SELECT start, max(len(path)) AS hops FROM p GROUP BY 1")
def vg5_longest(spark, d):
    return g.longest_chain(edges(spark, d).filter("rel = 'REPLACES'"), starts(spark, d), 10).select("start", F.size("path").cast("long").alias("hops"))


@reg("vg9_graph_dump", f"WITH {_EDGE} SELECT src, rel, dst FROM edges ORDER BY src, rel, dst LIMIT 30")
def vg9(spark, d):
    return edges(spark, d).orderBy("src", "rel", "dst").limit(30)


@reg("vg10_number_repair", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'n' || doc_id END AS number FROM documents")
def vg10(spark, d):
    n = table(spark, d, "documents").select("doc_id", F.concat(F.lit("law::"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 8 == 0, "unknown").when(F.col("doc_id") % 4 != 0, F.concat(F.lit("n"), F.col("doc_id").cast("string"))).alias("number"))
    return g.repaired_numbers(n).select("doc_id", "number")


@reg("sk9_supersedes_edge", f"WITH {_EDGE} SELECT src, rel, dst FROM edges UNION SELECT 1, 'SUPERSEDES', 2")
def sk9(spark, d):
    new = spark.createDataFrame([(1, "SUPERSEDES", 2), (1, "SUPERSEDES", 2)], "src long, rel string, dst long")
    return edges(spark, d).unionByName(new).dropDuplicates(["src", "rel", "dst"])
