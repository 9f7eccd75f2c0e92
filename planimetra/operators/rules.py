"""Risk rules and repair scope of damage regions, as joins with small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rule id, trigger classes, surfaces, least extent, suspected issue, recommendation, confidence.
RULES = [
    ("RULE_WATER_STAIN_WALL_CAVITY", ["water_stain"], ["wall"], 0.01, "Possible concealed moisture accumulation behind wall finish and insulation dampness", "Perform pinless and pin-probe moisture metering of wall cavity and inspect plumbing supply/drain runs", 0.88),
    ("RULE_WATER_STAIN_CEILING_PLENUM", ["water_stain"], ["ceiling"], 0.01, "Possible active or prior overhead leak from roof assembly, HVAC pan, or upper floor plumbing", "Access ceiling plenum or attic space directly above staining to trace origin and check joist deflection", 0.92),
    ("RULE_MOLD_DISCOLORATION_SAMPLING", ["mold_like_discoloration", "mold"], ["wall", "ceiling", "floor"], 0.005, "Suspected surface microbial colony potentially indicating elevated indoor relative humidity or hidden moisture reservoir", "Commission certified industrial hygienist (CIH) or mold assessor for tape-lift/air sampling; do not disturb dry surface", 0.85),
    ("RULE_CRACK_STRUCTURAL_SHEAR", ["crack_structural"], ["wall"], 0.25, "Potential structural settlement, foundation movement, or lateral load-bearing shear compromise", "Retain licensed structural engineer to evaluate foundation integrity, framing load paths, and plumbness", 0.90),
    ("RULE_BURN_CHAR_FRAMING", ["burn_or_char", "fire_smoke"], ["wall", "ceiling"], 0.05, "Possible loss of structural wood member section or compromised electrical wiring inside wall cavity", "Expose stud cavity to inspect framing char depth and retain licensed electrical contractor to test wiring continuity", 0.95),
    ("RULE_HOLE_CAVITY_EXPOSURE", ["hole_or_missing_material"], ["wall", "ceiling"], 0.02, "Breached interior envelope potentially compromising air barrier, acoustic rating, or fire separation", "Inspect internal cavity for insulation displacement, draft penetrations, and pest intrusion before closure", 0.82),
]

# Scope texts by class; {s} is the surface.
MOLD, CRACK, BURN = ("mold", "mold_like_discoloration"), ("crack_structural", "surface_crack"), ("burn_or_char", "fire_smoke")
DIAGNOSTIC = [
    (("water_stain",), "Moisture mapping and non-invasive cavity moisture survey of {s}"),
    (MOLD, "Microbial swab sampling and indoor air quality diagnostic evaluation"),
    (CRACK, "Structural crack monitoring gauge installation and substrate assessment on {s}"),
    (BURN, "Structural framing char depth inspection and smoke odor penetration survey"),
    ((), "Substrate physical condition inspection on {s}"),
]
CONTAINMENT = [((*MOLD, "burn_or_char"), "Set up critical dust containment barrier and negative air filtration")]
REMOVAL = [
    (("water_stain",), "Controlled removal and bagging of water-saturated {s} finish and insulation"),
    (MOLD, "HEPA vacuuming and antimicrobial wipe down of exposed substrate on {s}"),
    (CRACK, "V-groove mechanical chase routing and substrate crack preparation along {s}"),
    (("hole_or_missing_material",), "Square-cut removal of damaged drywall substrate back to adjacent framing studs on {s}"),
    (("burn_or_char",), "Abrasive blasting / soda blasting of charred surface and demolition of scorched {s}"),
    ((), "Mechanical preparation and removal of deteriorated material on {s}"),
]
FINISH = [
    (CRACK, "Apply fiberglass mesh tape, structural elastomeric joint compound, and feather texture on {s}"),
    (("water_stain", "hole_or_missing_material"), "Install new gypsum board to match existing thickness, tape, 3-coat finish, primer, and 2-coat paint on {s}"),
    (MOLD, "Apply antimicrobial encapsulant coating and repaint {s} to match existing"),
    (("surface_peeling",), "Scrape loose edges, apply stabilizing skim coat, primer, and finish coat on {s}"),
    ((), "Apply surface patching compound, prime, and repaint {s} to match existing"),
]


def rule_table(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_id string, classes array<string>, surfaces array<string>, least_extent double, issue string, recommendation string, rule_confidence double")


def flags(regions: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule that fires on a region (damage_id, damage_class, surface_type, area, length); a rule without surfaces fires on all.

    rules is exploded to one row a class, so it joins by equality. The extent is the area in m² or, failing that, the length in m; the
    evidence names it with its unit. A region with neither counts as 0 and its evidence names none.
    """
    exploded = rules.withColumn("damage_class", F.explode("classes")).drop("classes")
    fired = regions.join(exploded, "damage_class").filter(((F.size("surfaces") == 0) | F.array_contains("surfaces", F.col("surface_type"))) & (F.coalesce("area", "length", F.lit(0.0)) >= F.col("least_extent")))
    span = F.when(F.col("area").isNotNull(), F.format_string(" spanning %.2f m²", "area")).when(F.col("length").isNotNull(), F.format_string(" spanning %.2f m", "length")).otherwise("")
    evidence = F.concat(F.format_string("Observed %s on %s (%s)", "damage_class", "surface_type", F.col("damage_id").cast("string")), span)
    return fired.select("damage_id", "rule_id", "issue", "recommendation", "rule_confidence", evidence.alias("evidence"))


def _text(table: list[tuple]) -> Column:
    out = F.lit(None).cast("string")
    for classes, text in reversed(table):
        out = F.when(F.col("damage_class").isin(*classes), F.lit(text)).otherwise(out) if classes else F.lit(text)
    return F.replace(out, F.lit("{s}"), F.col("surface_type"))


def scope(regions: DataFrame) -> DataFrame:
    """Line items of each region (damage_id, damage_class, surface_type, area, length, status): step, action, quantity, unit.

    Quantities stay null unless the region is accepted or provisional and has an area or, failing that, a length.
    """
    sure = F.col("status").isin("ACCEPTED", "PROVISIONAL")
    quantity = F.when(sure, F.coalesce("area", "length"))
    unit = F.when(sure & F.col("area").isNotNull(), "m2").when(sure & F.col("length").isNotNull(), "linear_m").otherwise("count")
    one = F.lit(1.0)
    item = lambda step, table, q, u: F.struct(F.lit(step).alias("step"), _text(table).alias("action"), q.alias("quantity"), u.alias("unit"))
    items = F.array(
        item("01_diag", DIAGNOSTIC, one, F.lit("inspection")), item("02_contain", CONTAINMENT, one, F.lit("setup")),
        item("03_remed", REMOVAL, quantity, unit), item("04_finish", FINISH, quantity, unit),
    )
    table = regions.withColumn("_i", F.explode(F.filter(items, lambda i: i["action"].isNotNull())))
    return table.select(F.concat_ws("_item_", F.col("damage_id").cast("string"), F.col("_i.step")).alias("line_item_id"), "damage_id", "_i.action", "_i.quantity", "_i.unit")


def with_children(regions: DataFrame, fired: DataFrame, items: DataFrame) -> DataFrame:
    """regions with their rules and scope lines as sorted arrays, empty where there are none."""
    lists = lambda df, column, name: df.groupBy("damage_id").agg(F.sort_array(F.collect_list(column)).alias(name))
    out = regions.join(lists(fired, "rule_id", "rules"), "damage_id", "left").join(lists(items, "line_item_id", "line_items"), "damage_id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({"rules": F.coalesce("rules", empty), "line_items": F.coalesce("line_items", empty)})
