"""Geometry of boxes around text in images: corners as an array of (x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The share of the image's area, or of its width, from which a plate fills the image.
CLOSE_AREA, CLOSE_WIDTH = 0.12, 0.60


def bounds(corners: Column) -> Column:
    """(left, top, right, bottom) of a polygon's corners; null without corners."""
    x, y = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    return F.when(F.size(corners) > 0, F.struct(F.array_min(x).alias("left"), F.array_min(y).alias("top"), F.array_max(x).alias("right"), F.array_max(y).alias("bottom")))


def union(boxes: Column) -> Column:
    """The smallest box around an array of boxes; null without any. Null boxes count nowhere."""
    real = F.filter(boxes, lambda b: b.isNotNull())
    side = lambda pick, n: pick(F.transform(real, lambda b: b[n])).alias(n)
    return F.when(F.size(real) > 0, F.struct(side(F.array_min, "left"), side(F.array_min, "top"), side(F.array_max, "right"), side(F.array_max, "bottom")))


def fractions(box: Column, width: Column, height: Column) -> Column:
    """(area, width): a box's shares of an image. Without a box both are 0; an image without extent counts as one point."""
    w, h = box["right"] - box["left"], box["bottom"] - box["top"]
    some = lambda n: F.when(n == 0, 1).otherwise(n)
    share = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(share(w * h / some(width * height)).alias("area"), share(w / some(width)).alias("width"))


def is_closeup(box: Column, width: Column, height: Column) -> Column:
    """Whether a plate fills so much of its image that no car can be seen around it."""
    share = fractions(box, width, height)
    return (share["area"] >= CLOSE_AREA) | (share["width"] >= CLOSE_WIDTH)


def plate_lines(texts: DataFrame, by: str = "image_id") -> DataFrame:
    """Of the texts found in each image those of its plate: ``by``, text, confidence and corners, with box.

    The anchor is the text that, repaired, is a valid plate, else one of a plate's pattern, else the longest, then the most confident, then the first by
    text. With it go the texts beside it on its line (half its height above or below, twice its width to either side) and those right above or below (one and a half
    heights). The emblem IND and blank texts never belong to it, unless an image has at most one text besides: then all its texts stay.
    """
    from concordia.operators.blocking import CIVIL, repaired
    from concordia.operators.open_world import is_valid

    signs = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^A-Z0-9]", "")
    rows = texts.withColumns({"box": bounds(F.col("corners")), "_signs": signs})
    rows = rows.withColumn("_real", F.col("box").isNotNull() & ~F.col("_signs").isin("", "IND"))
    fixed = F.coalesce(F.get(repaired(F.col("_signs")), F.lit(0)), F.col("_signs"))
    rank = F.struct(F.col("_real").alias("real"), is_valid(fixed).alias("valid"), fixed.rlike(CIVIL).alias("shaped"), F.length("_signs").alias("n"), F.coalesce("confidence", F.lit(0.0)).alias("sure"))
    best = rows.select(by, rank.alias("_rank"), "box", "_signs", "_real").groupBy(by).agg(F.max_by("box", F.struct("_rank", "_signs")).alias("_anchor"), F.count_if("_real").alias("_n"))
    out = rows.join(best.select(F.col(by).alias("_by"), "_anchor", "_n"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    a, b = F.col("_anchor"), F.col("box")
    one = F.lit(1.0)
    h, w = F.greatest(one, a["bottom"] - a["top"]), F.greatest(one, a["right"] - a["left"])
    near = lambda up, aside: (b["bottom"] >= a["top"] - up * h) & (b["top"] <= a["bottom"] + up * h) & (b["right"] >= a["left"] - aside * w) & (b["left"] <= a["right"] + aside * w)
    keep = (F.col("_n") <= 1) | F.col("_real") & (near(0.5, 2) | near(1.5, 0))
    return out.filter(keep).select(*texts.columns, "box")
