"""Evaluation: errors, matching of predictions to references, interval audits, comparisons and gates.

Missing evidence is reported as NOT_EVALUABLE with null counts, never guessed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planimetra.functions.gates import reasons
from planimetra.functions.uncertainty import absolute_error, known, relative_error, sound_interval

SCALAR_TYPES = ("floor_area", "perimeter", "ceiling_height")
ANGLE_DEGREES, DISTANCE_M, AMBIGUOUS = 20.0, 1.5, 0.15


def with_errors(rows: DataFrame) -> DataFrame:
    p, r = F.col("predicted"), F.col("reference")
    return rows.withColumns({"absolute_error": absolute_error(p, r), "relative_error": relative_error(p, r)})


def error_statistics(rows: DataFrame, error: str = "absolute_error", keys: list[str] = ()) -> DataFrame:
    """n, mean, median, rmse, population std, min and max of the errors that are known; nulls and 0 without any."""
    x = known(F.col(error))
    return rows.withColumn("_e", x).groupBy(*keys).agg(
        F.count("_e").alias("n"),
        *[F.round(f, 5).alias(name) for name, f in (("mean", F.avg("_e")), ("median", F.median("_e")), ("rmse", F.sqrt(F.avg(F.col("_e") * F.col("_e")))), ("std", F.stddev_pop("_e")), ("least", F.min("_e")), ("largest", F.max("_e")))],
    )


def dimension_key(room: str = "room_id", kind: str = "type", entity: str = "entity") -> Column:
    return F.concat_ws("_", F.lower(F.trim(F.col(room).cast("string"))), F.lower(F.trim(F.col(kind))), F.lower(F.trim(F.col(entity).cast("string"))))


def last_of_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, as a later entry replaces an earlier one."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("_r"))
    return best.select(key, "_r.*")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def incumbent_details(truth: DataFrame, ours: DataFrame, incumbent: DataFrame, tie: float = 0.002) -> DataFrame:
    """Dimensions (key, value) that all three know, with both errors and BEAT, TIE or LOSS. Keys are unique in each."""
    joined = incumbent.withColumnRenamed("value", "incumbent").join(truth.withColumnRenamed("value", "truth"), "key").join(ours.filter("value is not null").withColumnRenamed("value", "ours"), "key")
    e, i = F.abs(F.col("ours") - F.col("truth")), F.abs(F.col("incumbent") - F.col("truth"))
    outcome = F.when(F.abs(e - i) <= tie, "TIE").when(e < i, "BEAT").otherwise("LOSS")
    return joined.select("key", "truth", "ours", "incumbent", e.alias("our_error"), i.alias("incumbent_error"), outcome.alias("outcome"))


def incumbent_summary(details: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    beat, tie = F.count_if(F.col("outcome") == "BEAT"), F.count_if(F.col("outcome") == "TIE")
    return details.agg(
        F.when(n > 0, "EVALUATED").otherwise("NOT_EVALUABLE").alias("status"), n.alias("shared"), beat.alias("beat"), tie.alias("tie"), F.count_if(F.col("outcome") == "LOSS").alias("loss"),
        F.round((beat + tie) / F.nullif(n, F.lit(0)), 4).alias("beat_tie_ratio"), F.round(F.avg("our_error"), 4).alias("our_mae"), F.round(F.avg("incumbent_error"), 4).alias("incumbent_mae"),
    )


def interval_audit(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Soundness, relative widths (of values over 1e-6) and, where a reference is known, coverage of intervals."""
    p, lo, hi, r = (F.col(c) for c in ("predicted", "lower", "upper", "reference"))
    width = F.when(sound_interval(p, lo, hi) & (F.abs(p) > 1e-6), (hi - lo) / F.abs(p))
    tested = known(r).isNotNull() & sound_interval(p, lo, hi)
    table = rows.withColumns({"_w": width, "_t": tested, "_c": tested & (lo <= r) & (r <= hi)}).groupBy(*keys)
    return table.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sound_interval(p, lo, hi)).alias("sound"), F.round(F.avg("_w"), 4).alias("mean_width"), F.round(F.min("_w"), 4).alias("least_width"),
        F.round(F.max("_w"), 4).alias("largest_width"), F.count_if("_t").alias("tested"), F.round(F.count_if("_c") / F.nullif(F.count_if("_t"), F.lit(0)), 4).alias("coverage"),
        F.when(F.count_if("_t") > 0, "CALIBRATED").otherwise("UNCALIBRATED").alias("status"),
    )


def match_scalars(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """One-to-one quantities of a room: room, type, n_predicted, n_reference, score and status.

    One of each is MATCHED by their difference; with one side missing the other is PHANTOM or MISSED; else AMBIGUOUS.
    """
    keys = [F.lower(F.trim(F.col("room_id").cast("string"))).alias("room"), F.lower(F.trim("type")).alias("type")]
    side = lambda df, name: df.filter(F.lower(F.trim("type")).isin(*SCALAR_TYPES)).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min("value").alias(name))
    both = side(predictions, "predicted").join(side(references, "reference"), ["room", "type"], "full_outer").na.fill(0, ["n_predicted", "n_reference"])
    one = (F.col("n_predicted") == 1) & (F.col("n_reference") == 1)
    status = F.when(one, "MATCHED").when(F.col("n_reference") == 0, "PHANTOM").when(F.col("n_predicted") == 0, "MISSED").otherwise("AMBIGUOUS")
    return both.select("room", "type", "n_predicted", "n_reference", F.when(one, F.abs(F.col("predicted") - F.col("reference"))).alias("score"), status.alias("status"))


def _costs(p: dict, refs: list[dict]) -> list[tuple[float, int]]:
    out = []
    for i, r in enumerate(refs):
        cost = 0.0
        if p["surface"] and r["surface"] and p["surface"].lower() != r["surface"].lower():
            continue
        if p["angle"] is not None and r["angle"] is not None:
            turn = abs(p["angle"] - r["angle"]) % 360
            turn = min(turn, 360 - turn)
            turn = min(turn, 180 - turn)
            if turn > ANGLE_DEGREES:
                continue
            cost += 0.4 * turn / ANGLE_DEGREES
        if p["centroid"] is not None and r["centroid"] is not None and len(p["centroid"]) == len(r["centroid"]):
            far = math.dist(p["centroid"], r["centroid"])
            if far > DISTANCE_M:
                continue
            cost += 0.4 * far / DISTANCE_M
        out.append((cost + 0.2 * abs(p["value"] - r["value"]) / max(p["value"], r["value"], 0.1), i))
    return sorted(out)


def match_features(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Greedy matching of walls and openings in each room and type, in order of ord.

    Both: room, type, ord, entity, value, angle, centroid, surface. A prediction takes the cheapest free reference unless
    the second is nearly as cheap; then it is AMBIGUOUS and takes none. A group is a room's features of a type, which is small.
    """
    schema = "room string, type string, predicted string, reference string, score double, status string"
    fields = ["ord", "entity", "value", "angle", "centroid", "surface"]
    packed = lambda df, name: df.groupBy("room", "type").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    groups = packed(predictions, "predictions").join(packed(references, "references"), ["room", "type"], "full_outer")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for group in batch.to_pylist():
                free = group["references"] or []
                rows = []
                for p in group["predictions"] or []:
                    costs = _costs(p, free)
                    if not costs:
                        rows.append((p["entity"], None, None, "PHANTOM"))
                    elif len(costs) > 1 and costs[1][0] - costs[0][0] < AMBIGUOUS:
                        rows.append((p["entity"], None, costs[0][0], "AMBIGUOUS"))
                    else:
                        rows.append((p["entity"], free.pop(costs[0][1])["entity"], costs[0][0], "MATCHED"))
                rows += [(None, r["entity"], None, "MISSED") for r in free]
                out += [(group["room"], group["type"], *row) for row in rows]
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string())
            names = ["room", "type", "predicted", "reference", "score", "status"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return groups.mapInArrow(match, schema)


def repeatability(pairs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Share of matched walls (predicted, reference) within 1 cm or half a per cent of each other."""
    rows = with_errors(pairs)
    inside = (F.col("absolute_error") <= 0.01) | F.coalesce(F.col("relative_error") <= 0.005, F.lit(False))
    n = F.count("absolute_error")
    return rows.groupBy(*keys).agg(F.when(n > 0, "EVALUATED").otherwise("NOT_EVALUABLE").alias("status"), n.alias("compared"), F.count_if(inside).alias("within"), F.round(F.count_if(inside) / F.nullif(n, F.lit(0)), 4).alias("ratio"))


def gate(rows: DataFrame, name: str, passes: Column, share: float, total: Column | None = None, keys: list[str] = ()) -> DataFrame:
    """One gate: numerator, denominator (total, else the rows) and PASS, FAIL or, for no rows, NOT_EVALUABLE with nulls."""
    n = F.count(F.lit(1)) if total is None else total
    good = F.count_if(passes)
    result = F.when(n == 0, "NOT_EVALUABLE").when(good / F.nullif(n, F.lit(0)) >= share, "PASS").otherwise("FAIL")
    return rows.groupBy(*keys).agg(F.lit(name).alias("gate"), F.when(n > 0, good).alias("numerator"), F.when(n > 0, n).alias("denominator"), F.lit(share).alias("threshold"), result.alias("result"))


def opening_gate(matched: DataFrame) -> DataFrame:
    """At most 2 cm on 85 %; phantom predictions and missed references both count in the denominator max(references, predictions)."""
    total = F.greatest(F.count("reference"), F.count("predicted"))
    evaluable = F.count("reference") > 0
    good = F.count_if(absolute_error(F.col("predicted"), F.col("reference")) <= 0.02)
    return matched.agg(
        F.lit("opening_width").alias("gate"), F.when(evaluable, good).alias("numerator"), F.when(evaluable, total).alias("denominator"), F.lit(0.85).alias("threshold"),
        F.when(~evaluable, "NOT_EVALUABLE").when(good / F.nullif(total, F.lit(0)) >= 0.85, "PASS").otherwise("FAIL").alias("result"),
    )


def gates(matched: DataFrame) -> DataFrame:
    """The share gates of matched dimensions (tier, type, predicted, reference)."""
    rows = with_errors(matched)
    of = lambda tier, kind: rows.filter((F.col("tier") == tier) & (F.col("type") == kind) & F.col("reference").isNotNull())
    near = lambda column, limit: F.coalesce(F.col(column) <= limit, F.lit(False))
    parts = [
        opening_gate(rows.filter((F.col("tier") == "lidar") & (F.col("type") == "opening_width"))),
        gate(of("lidar", "ceiling_height"), "ceiling_height", near("absolute_error", 0.015), 1.0),
        gate(of("video", "wall_length"), "video_walls", near("relative_error", 0.03), 0.85),
        gate(of("photo", "wall_length"), "photo_walls", near("relative_error", 0.08), 0.80),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compare_tiers(one: DataFrame, two: DataFrame, key: str = "key") -> DataFrame:
    """Counts of shared and unmatched dimensions of two tiers (key, value) and statistics of their differences."""
    both = one.select(key, F.col("value").alias("predicted")).join(two.select(key, F.col("value").alias("reference")), key, "full_outer")
    rows = with_errors(both)
    return rows.agg(
        F.count_if(F.col("predicted").isNotNull() & F.col("reference").isNotNull()).alias("shared"), F.count_if(F.col("reference").isNull()).alias("only_first"), F.count_if(F.col("predicted").isNull()).alias("only_second"),
        F.round(F.avg("absolute_error"), 5).alias("mean"), F.round(F.median("absolute_error"), 5).alias("median"), F.round(F.max("absolute_error"), 5).alias("largest"),
    )


def damage_fixtures(fixtures: DataFrame, predictions: DataFrame) -> DataFrame:
    """Errors of predicted areas and lengths by fixture; fixtures without a prediction keep nulls."""
    joined = fixtures.join(predictions, "fixture_id", "left")
    return joined.withColumns({f"{c}_error": relative_error(F.col(f"predicted_{c}"), F.col(f"true_{c}")) for c in ("area", "length")} | {"class_right": F.col("predicted_class") == F.col("true_class")})


def worst_failure(tiers: DataFrame) -> DataFrame:
    """The failure to mend first, from tier, coverage and failures (array), by fixed rank; the openings candidate needs only a lidar tier."""
    has = lambda name: F.array_contains("failures", name)
    found = tiers.select(
        "tier",
        F.when((F.col("tier") == "video") & (has("registration_failure") | (F.col("coverage") < 0.5)), F.struct(F.lit(95).alias("rank"), F.lit("video registration").alias("name")))
        .when((F.col("tier") == "photo") & (has("topology_failure") | (F.col("coverage") < 0.6)), F.struct(F.lit(80).alias("rank"), F.lit("photo topology").alias("name")))
        .when(F.col("tier") == "lidar", F.struct(F.lit(60).alias("rank"), F.lit("opening bounds").alias("name")))
        .alias("c"),
    )
    return found.filter("c is not null").orderBy(F.desc("c.rank"), "tier").limit(1).select("tier", "c.rank", "c.name")


def document_difference(one: DataFrame, two: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Rooms (room_id, area) of two documents: EXACT, EQUIVALENT or DIFFERENT. A room without its id in the other takes the
    first unmatched one there of nearly its area."""
    a, b = one.select("room_id", F.col("area").alias("area_a")), two.select(F.col("room_id").alias("other"), F.col("area").alias("area_b"))
    exact = a.join(b, F.col("room_id") == F.col("other"))
    left, right = a.join(b, F.col("room_id") == F.col("other"), "left_anti"), b.join(a, F.col("room_id") == F.col("other"), "left_anti")
    cell = lambda c: F.floor(F.col(c) / tolerance)
    spread = left.withColumn("_c", F.explode(F.array(cell("area_a") - 1, cell("area_a"), cell("area_a") + 1)))
    near = spread.join(right.withColumn("_c", cell("area_b")), "_c").filter(F.abs(F.col("area_a") - F.col("area_b")) < tolerance).drop("_c")
    first = near.withColumn("_r", F.row_number().over(Window.partitionBy("room_id").orderBy("other"))).filter("_r = 1").withColumn("_s", F.row_number().over(Window.partitionBy("other").orderBy("room_id"))).filter("_s = 1").drop("_r", "_s")
    matched = exact.unionByName(first)
    rest = a.join(matched.select("room_id"), "room_id", "left_anti").withColumns({"other": F.lit(None).cast(dict(b.dtypes)["other"]), "area_b": F.lit(None).cast("double")})
    verdict = F.when(F.col("other").isNull(), "DIFFERENT").when(F.col("area_a") == F.col("area_b"), "EXACT").when(F.abs(F.col("area_a") - F.col("area_b")) < tolerance, "EQUIVALENT").otherwise("DIFFERENT")
    return matched.unionByName(rest).withColumn("verdict", verdict)


def determinism(runs: DataFrame, keys: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Values (run, keys.., value) of each later run against run 1: largest difference and whether all agree."""
    base = runs.filter("run = 1").select(*keys, F.col("value").alias("_base"))
    joined = runs.filter("run > 1").join(base, keys, "full_outer").withColumn("_d", F.abs(F.col("value") - F.col("_base")))
    return joined.groupBy("run").agg(F.max("_d").alias("largest"), F.bool_and(F.coalesce(F.col("_d") <= tolerance, F.lit(False))).alias("agrees")).filter("run is not null")


def tier_status(tiers: DataFrame) -> DataFrame:
    """COMPLETE, PROVISIONAL, FAILED or NOT_EVALUABLE of a tier row (tier, coverage, failures, produced); video is never COMPLETE."""
    found = reasons(no_output=F.col("produced") == 0, low_coverage=F.col("coverage") < 0.5, failures=F.size("failures") > 0, video=F.col("tier") == "video")
    status = F.when(F.col("produced").isNull(), "NOT_EVALUABLE").when(F.col("produced") == 0, "FAILED").when(F.size(found) == 0, "COMPLETE").otherwise("PROVISIONAL")
    return tiers.withColumns({"reasons": found, "status": status})
