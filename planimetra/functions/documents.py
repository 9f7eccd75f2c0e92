"""Documents of unknown shape as VARIANT columns: routing by keys, statuses, and values that may be numbers or objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What other spellings of a status mean; an unknown one is complete for lidar and provisional for others.
STATUSES = {"COMPLETE": ("COMPLETE", "ACCEPTED", "SUCCEEDED"), "PROVISIONAL": ("PROVISIONAL",), "NOT_EVALUABLE": ("NOT_EVALUABLE",), "FAILED": ("FAILED", "INVALID", "REJECTED")}


def parsed(text: Column) -> Column:
    """The document, null if the text is null or no JSON."""
    return F.try_parse_json(text)


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, NUMBER, BOOLEAN or VOID; null for no value."""
    shape = F.schema_of_variant(value)
    name = F.regexp_extract(shape, "^[A-Z]+", 0)
    return F.when(name.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT"), "NUMBER").otherwise(name)


def at(document: Column, path: str, kind_: str = "variant") -> Column:
    """What stands at a path of a document, as kind_; null if nothing does or it is something else."""
    return F.try_variant_get(document, path, kind_)


def is_given(value: Column) -> Column:
    """Whether a value counts as given: not missing, null, false, zero or an empty text."""
    shape = kind(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    empty = (shape == "VOID") | ((shape == "BOOLEAN") & (text == "false")) | ((shape == "NUMBER") & (number == 0)) | ((shape == "STRING") & (text == ""))
    return F.coalesce(value.isNotNull() & ~empty, F.lit(False))


def route(document: Column) -> Column:
    """Which reader a document goes to: 'failure', 'single_room' or 'property'; anything but an object or array is a failure."""
    shape = kind(document)
    rooms, reasons = at(document, "$.rooms"), at(document, "$.failure_reasons")
    no_rooms = (kind(rooms) == "ARRAY") & (F.size(at(document, "$.rooms", "array<variant>")) == 0) & (kind(reasons) == "ARRAY")
    status = at(document, "$.status")
    not_evaluable = (kind(status) == "STRING") & (at(document, "$.status", "string") == "NOT_EVALUABLE")
    failed = ~F.coalesce(shape.isin("OBJECT", "ARRAY"), F.lit(False)) | F.coalesce(not_evaluable | no_rooms, F.lit(False))
    single = (shape == "OBJECT") & (is_given(at(document, "$.room_polygon")) | is_given(at(document, "$.measurements")))
    return F.when(failed, "failure").when(F.coalesce(single, F.lit(False)), "single_room").otherwise("property")


def failure_reason(document: Column) -> Column:
    """Reasons that a failed document names, ['empty_payload'] for one that is none, else null."""
    given = F.filter(at(document, "$.failure_reasons", "array<string>"), lambda r: r.isNotNull())
    broken = ~F.coalesce(kind(document).isin("OBJECT", "ARRAY"), F.lit(False))
    return F.when(broken, F.array(F.lit("empty_payload"))).when(route(document) == "failure", F.coalesce(given, F.array().cast("array<string>")))


def normal_status(value: Column, tier: Column) -> Column:
    """COMPLETE, PROVISIONAL, NOT_EVALUABLE or FAILED; video is never COMPLETE. value: a variant."""
    said = F.when(kind(value) == "STRING", F.upper(F.try_variant_get(value, "$", "string")))
    meant = F.lit(None).cast("string")
    for status, spellings in STATUSES.items():
        meant = F.when(said.isin(*spellings), status).otherwise(meant)
    video = F.when(said.isin("NOT_EVALUABLE", "FAILED"), said).otherwise("PROVISIONAL")
    return F.when(tier == "video", video).otherwise(F.coalesce(meant, F.when(tier == "lidar", "COMPLETE").otherwise("PROVISIONAL")))


def measured(value: Column, unit: str = "m") -> Column:
    """struct (value, unit, lower, upper, confidence, method) of a number, or of an object with a number in it; null for all else.

    lower and upper come from lower_bound and upper_bound, or from an interval of two numbers where either bound is missing; texts that look like numbers are none.
    """
    number = lambda path: F.when(kind(at(value, path)) == "NUMBER", at(value, path, "double"))
    text = lambda path: F.when(kind(at(value, path)) == "STRING", at(value, path, "string"))
    bare = F.when(kind(value) == "NUMBER", F.try_variant_get(value, "$", "double"))
    held = F.when(kind(value) == "OBJECT", number("$.value"))
    low, high, ends = number("$.lower_bound"), number("$.upper_bound"), at(value, "$.interval", "array<variant>")
    pair = (F.size(ends) == 2) & (kind(F.get(ends, F.lit(0))) == "NUMBER") & (kind(F.get(ends, F.lit(1))) == "NUMBER")
    end = lambda i: F.when(pair, F.try_variant_get(F.get(ends, F.lit(i)), "$", "double"))
    both = low.isNotNull() & high.isNotNull()
    given = F.struct(
        F.coalesce(bare, held).alias("value"), F.coalesce(F.when(held.isNotNull(), text("$.unit")), F.lit(unit)).alias("unit"), F.when(both, low).otherwise(F.coalesce(end(0), low)).alias("lower"),
        F.when(both, high).otherwise(F.coalesce(end(1), high)).alias("upper"), F.when(held.isNotNull(), number("$.confidence")).alias("confidence"), F.when(held.isNotNull(), text("$.method")).alias("method"),
    )
    return F.when(F.coalesce(bare, held).isNotNull(), given)
