"""Small mappings of capture metadata: pixels, keys, labels and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detector prompts and the damage class that each means.
TAXONOMY = {
    "water stain": "water_stain", "water damage": "water_stain", "moisture stain": "water_stain",
    "crack on wall": "surface_crack", "wall crack": "surface_crack", "hairline crack": "surface_crack",
    "structural crack": "crack_structural", "stair step crack": "crack_structural",
    "hole in wall": "hole_or_missing_material", "hole in drywall": "hole_or_missing_material", "damaged drywall": "hole_or_missing_material",
    "mold discoloration": "mold_like_discoloration", "mold stain": "mold_like_discoloration", "mildew stain": "mold_like_discoloration",
    "burn mark": "burn_or_char", "charred wall": "burn_or_char", "smoke damage": "fire_smoke",
    "surface breakage": "surface_breakage", "chipped plaster": "surface_breakage", "peeling paint": "surface_peeling",
    "damaged wall": "other_visible_damage", "damaged floor": "other_visible_damage", "damaged ceiling": "other_visible_damage",
}


def damage_class(prompt: Column, taxonomy: dict[str, str] = TAXONOMY) -> Column:
    table = F.create_map(*[F.lit(x) for pair in taxonomy.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.trim(F.lower(prompt))), F.lit("other_visible_damage"))


def opening_class(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.contains("window"), "window").when(low.contains("doorway") | low.contains("open door"), "doorway").otherwise("door")


def clipped_at_border(x1, y1, x2, y2, width, height, margin: int = 6) -> Column:
    return (x1 <= margin) | (y1 <= margin) | (x2 >= width - margin) | (y2 >= height - margin)


def rotated_pixel(u: Column, v: Column, width: Column, height: Column, degrees: Column) -> Column:
    """struct (u, v) of a pixel after the image is turned clockwise by 0, 90, 180 or 270 degrees; null for other angles."""
    pixel = lambda a, b: F.struct(a.cast("double").alias("u"), b.cast("double").alias("v"))
    return (
        F.when(degrees == 0, pixel(u, v)).when(degrees == 90, pixel(height - 1 - v, u))
        .when(degrees == 180, pixel(width - 1 - u, height - 1 - v)).when(degrees == 270, pixel(v, width - 1 - u))
    )


def image_pair(pair_id: Column, base: int = 2147483647) -> Column:
    """struct (a, b) of the two image ids in a pair id; both 0 if either is not positive."""
    b = F.pmod(pair_id, F.lit(base))
    a = ((pair_id - b) / base).cast("long")
    sound = (a > 0) & (b > 0)
    return F.struct(F.when(sound, a).otherwise(0).cast("long").alias("a"), F.when(sound, b).otherwise(0).cast("long").alias("b"))


def aspect_ratio(width: Column, height: Column) -> Column:
    known = [(4, 3), (16, 9), (3, 2), (1, 1)]
    return F.coalesce(*[F.when(width * b == height * a, F.lit(f"{a}:{b}")) for a, b in known], F.lit("other"))


def orientation(width: Column, height: Column, rotation: Column) -> Column:
    turned = F.pmod(rotation, F.lit(180)) == 90
    return F.when(turned, F.when(width > height, "portrait").otherwise("landscape")).otherwise(F.when(height > width, "portrait").otherwise("landscape"))


def height_colour(y: Column) -> Column:
    """struct (r, g, b) of a height on a ramp from -1.2 m (blue) to 1.3 m (red)."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y + 1.2) / 2.5))
    return F.struct((240 * t).cast("int").alias("r"), (180 * (1 - 2 * F.abs(t - 0.5))).cast("int").alias("g"), (240 * (1 - t)).cast("int").alias("b"))


def scaled_translation(vector: Column, scale: Column) -> Column:
    return F.transform(vector, lambda x: x * scale)


def scaled_intrinsics(fx, fy, cx, cy, to=(256, 192), of=(1920, 1440)) -> Column:
    sx, sy = to[0] / of[0], to[1] / of[1]
    return F.struct((fx * sx).alias("fx"), (fy * sy).alias("fy"), (cx * sx).alias("cx"), (cy * sy).alias("cy"))


def safe_capture_id(name: Column) -> Column:
    """Whether an id can name a folder: not null or empty, without '..' and without slashes of either kind."""
    bad = (F.length(name) == 0) | F.contains(name, F.lit("..")) | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\"))
    return F.coalesce(~bad, F.lit(False))
