"""Compliance rules as tables and conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.operators.intervals import interval_join

# Fixed values of the rules: words, dates, tables and messages that results must equal.
EXCLUDED_WORDS = ("thuốc nổ", "kho đạn", "pháo hoa", "lọc dầu", "hóa dầu", "hạt nhân", "lò phản ứng", "công trình biển", "giàn khoan")
NEW_LAW_DATE = "2026-07-01"
MANDATORY_PARTS = ("QCVN", "QCXDVN", "LUẬT", "LUAT", "NĐ-CP", "ND-CP", "TT-BXD")
CITED_STANDARDS = ("TCVN 7336", "TCVN 3890", "TCVN 5738", "TCVN 2622", "TCVN 9383", "TCVN 9311", "TCVN 3254")
UNREGULATED = "Không quy định"
ELEMENTS = ("load_bearing_wall", "column", "floor", "roof", "truss_beam_purlin", "wall_inner", "staircase")
RATINGS = {
    "I": ("R 120", "R 120", "REI 60", "RE 30", "R 30", "REI 120", "R 60"),
    "II": ("R 90", "R 90", "REI 45", "RE 15", "R 15", "REI 90", "R 60"),
    "III": ("R 45", "R 45", "REI 45", "RE 15", "R 15", "REI 60", "R 45"),
    "IV": ("R 15", "R 15", "REI 15", "RE 15", "R 15", "REI 45", "R 15"),
    "V": (UNREGULATED,) * 7,
}
STEP_DOWN = {"REI 120": "REI 90", "REI 90": "REI 60", "REI 60": "REI 45", "REI 45": "REI 30", "REI 30": "REI 15", "R 120": "R 90", "R 90": "R 60", "R 60": "R 45", "R 45": "R 30", "R 30": "R 15", "RE 30": "RE 15"}
#: Upper volumes (inclusive) of the flow brackets; each adds 10 (classes A-C) or 5 l/s.
FLOW_VOLUMES = (50_000, 100_000, 200_000, 300_000, 400_000, 500_000, 600_000, 700_000)


def rating_table(spark: SparkSession) -> DataFrame:
    rows = [(g, e, v) for g, values in RATINGS.items() for e, v in zip(ELEMENTS, values, strict=True)]
    return spark.createDataFrame(rows, "grade string, element string, base_rei string")


def step_down(rating: Column) -> Column:
    """One step lower, or the same at the lowest."""
    steps = F.create_map(*[F.lit(x) for kv in STEP_DOWN.items() for x in kv])
    return F.coalesce(F.try_element_at(steps, rating), rating)


def element_ratings(buildings: DataFrame) -> DataFrame:
    """Base and final rating of each building's element, and the notes that apply.

    buildings: grade, element, has_sprinkler, no_attic, has_auto_alarm, wall_group,
    floor_group and any keys."""
    t = F.broadcast(rating_table(buildings.sparkSession))
    b = buildings.withColumn("grade", F.when(F.col("grade").isin(*RATINGS), F.col("grade")).otherwise("I")).join(t, ["grade", "element"], "left")
    b = b.withColumn("base_rei", F.coalesce("base_rei", F.lit(UNREGULATED)))
    ruled = F.col("base_rei") != UNREGULATED
    one = ruled & F.col("has_sprinkler") & F.col("no_attic") & F.col("element").isin("roof", "truss_beam_purlin")
    two = ruled & F.col("has_auto_alarm") & (F.col("wall_group") == "A") & (F.col("element") == "wall_inner")
    three = ruled & F.col("has_sprinkler") & (F.col("floor_group") == "B1") & (F.col("element") == "floor")
    final = F.when(one, F.when(F.col("element") == "roof", "RE 15").otherwise("R 15")).when(two | three, step_down(F.col("base_rei"))).otherwise(F.col("base_rei"))
    notes = F.array_compact(F.array(F.when(one, 1), F.when(two, 2), F.when(three, 3)))
    return b.withColumns({"final_rei": final, "notes": notes})


def all_elements(buildings: DataFrame) -> DataFrame:
    """The seven elements of each building."""
    return element_ratings(buildings.withColumn("element", F.explode(F.array(*[F.lit(e) for e in ELEMENTS]))))


def flow_of(volume: Column, hazard: Column) -> Column:
    """Litres a second of one volume: a range lookup."""
    n = F.size(F.filter(F.array(*[F.lit(float(v)) for v in FLOW_VOLUMES]), lambda u: u < volume))
    return F.when(F.upper(F.trim(hazard)).rlike("[ABC]"), 20.0 + 10.0 * n).otherwise(10.0 + 5.0 * n)


def water_flow(df: DataFrame) -> DataFrame:
    """volume, hazard, height, compartments (array, may be null) to base and final flow."""
    parts = F.sort_array("compartments", asc=False)
    both = flow_of(parts[0], F.col("hazard")) + 0.5 * flow_of(parts[1], F.col("hazard"))
    base = F.when(F.size("compartments") > 1, both).otherwise(flow_of(F.col("volume"), F.col("hazard")))
    return df.withColumn("base_flow", base).withColumn("multiplier", F.when(F.col("height") >= 50, 1.5).otherwise(1.0)).withColumn("flow", F.round(F.col("base_flow") * F.col("multiplier"), 2))


def normative_force(identifier: Column, cited: Column, contract: Column) -> Column:
    clean = F.upper(F.trim(F.coalesce(identifier, F.lit(""))))
    has = lambda parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(clean, p))
    return (
        F.when(contract, "contract_adopted")
        .when(has(MANDATORY_PARTS), "mandatory")
        .when(F.contains(clean, F.lit("TCVN")) & (cited | has(CITED_STANDARDS)), "mandatory_by_reference")
        .otherwise("voluntary")
    )


def anchor_date(pccc: Column, permit: Column, design: Column, planning: Column) -> Column:
    """The first of the four that is there."""
    return F.coalesce(pccc, permit, design, planning)


def excluded_word(name: Column) -> Column:
    """The first excluded word in a name, or null."""
    words = F.array(*[F.lit(w) for w in EXCLUDED_WORDS])
    return F.try_element_at(F.filter(words, lambda w: F.contains(F.lower(name), w)), F.lit(1))


def scope_gate(projects: DataFrame, cutoff_06: str, cutoff_04: str) -> DataFrame:
    """Applicability, clearance, codes, era and locked editions of projects.

    projects: name, level, function, is_apartment, height, basements, pccc and anchor dates."""
    apartment = F.col("is_apartment") | F.col("function").isin("F1.1", "F1.2")
    word = excluded_word(F.col("name"))
    codes = F.when(apartment & F.col("level").isin("DAC_BIET", "I", "II", "III"), F.array(F.lit("QCVN 06"), F.lit("QCVN 04"))).otherwise(F.array(F.lit("QCVN 06")))
    at = F.coalesce("pccc", "anchor")
    out = projects.withColumns(
        {
            "reject": word,
            "applicable": word.isNull(),
            "special_clearance": word.isNull() & apartment & ((F.col("height") > 150) | (F.col("basements") > 3)),
            "codes": F.when(word.isNull(), codes),
            "era": F.when(F.col("anchor") >= F.lit(NEW_LAW_DATE).cast("date"), "LAW_2025").otherwise("LAW_2014"),
            "edition_06": F.when(at < F.lit(cutoff_06).cast("date"), "original").otherwise("amended"),
        }
    )
    return out.withColumn("edition_04", F.when(F.array_contains("codes", "QCVN 04"), F.when(at < F.lit(cutoff_04).cast("date"), "original").otherwise("amended")))


def edition_at(rows: DataFrame, key: str, day: str, editions: DataFrame) -> DataFrame:
    """rows (``key`` is theirs alone) with the edition for which valid_from <= day < valid_to;
    nulls are open ends, a day without an edition has none."""
    met = interval_join(rows.select(key, day), day, editions, "valid_from", "valid_to").drop(day)
    return rows.join(met, key, "left")


def charging_findings(params: DataFrame, grace_before: str = "2026-12-15") -> DataFrame:
    """Up to six findings of a charging area, whether one fails, and the grace warning."""
    base = F.col("location").isin("basement", "semi_basement")
    check = lambda name, ok, when=F.lit(True): F.when(when, F.struct(F.lit(name).alias("check"), ok.alias("passed")))
    separated = F.col("fire_wall") | (F.col("open_space") >= 6) | (F.col("drencher") & (F.col("drencher_flow") >= 1))
    found = F.array_compact(
        F.array(
            check("car_spots", F.col("car_spots") <= 25, base),
            check("moto_spots", F.col("moto_spots") <= 50, base),
            check("area", F.col("area") <= F.when(F.col("car_spots") > 0, 1200).otherwise(300), base),
            check("separation", separated),
            check("systems", F.col("alarm") & F.col("sprinkler") & F.col("smoke") & F.col("gas")),
            check("power", F.col("power") <= 22, base),
        )
    )
    out = params.withColumn("findings", found)
    bad = F.exists("findings", lambda x: ~x["passed"])
    return out.withColumns({"status": F.when(bad, "NON_COMPLIANT").otherwise("COMPLIANT"), "grace": F.coalesce(F.col("pccc") < F.lit(grace_before).cast("date"), F.lit(False))})


def overall_status(any_fail: Column, any_conditional: Column) -> Column:
    return F.when(any_fail, "NON_COMPLIANT").when(any_conditional, "CONDITIONAL").otherwise("COMPLIANT")


def repealed_citation(citation: Column, anchor: Column) -> Column:
    """A citation of the repealed circular under the new law."""
    return F.contains(F.upper(citation), F.lit("06/2021/TT-BXD")) & F.coalesce(anchor >= F.lit(NEW_LAW_DATE).cast("date"), F.lit(False))
