"""All keys that any source knows, with who holds them, and what cameras say of those that no register describes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions.transforms import title_case

from .open_world import is_valid

# How much a key that only cameras saw counts, and the confidence from which a sighting may speak of a car's look.
CAMERA_ONLY, SPEAKS = 0.3, 0.6
LOOKS = ("make", "model", "colour")


def _filled(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text != "", text)


def majority(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, value, n, total): the value that over half of a key's filled values have, whatever their case; keys without such a value have no row.

    Values are counted before they are shuffled by key, so a key with many rows is no hot one.
    """
    each = rows.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), title_case(_filled(F.col(c).cast("string"))).alias("value")) for c in columns))).alias("_v"))
    counted = each.select(key, "_v.*").filter("value is not null").groupBy(key, "column", "value").agg(F.count("*").alias("n"))
    most = counted.groupBy(key, "column").agg(F.max_by("value", "n").alias("value"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return most.filter(F.col("n") * 2 > F.col("total"))


def universe(official: dict[str, DataFrame], sightings: DataFrame, identity: str, camera: str = "CAM") -> DataFrame:
    """A row for each key: sources (identity's first, then by name), registered, prior, make, model, colour, fingerprint, sightings, seen_at, seen_where, held_by.

    official: a frame by source with key; identity's has make, model and colour as well. sightings: key, seen_at, seen_where, ocr_confidence,
    observed_make, observed_model, observed_colour, all rows. A look that the register lacks is what over half of the sightings
    with a confidence of ``SPEAKS`` or more agree on; fingerprint names those taken from them. A key that only cameras saw counts only if it is
    a valid plate, and then by ``CAMERA_ONLY``. The newest sighting is told, of several at once the greatest place; null and empty keys are left out.
    Of several rows of a key in the register the smallest look of each counts. One aggregation by key on either side, then joined.
    """
    if identity not in official:
        raise ValueError(f"{identity!r} is not among the sources")

    def rows(name: str, df: DataFrame) -> DataFrame:
        own = [_filled(F.col(c)) if name == identity else F.lit(None).cast("string") for c in LOOKS]
        return df.select("key", F.lit(name).alias("source"), *(v.alias(c) for v, c in zip(own, LOOKS)))

    known = reduce(DataFrame.unionByName, (rows(n, df) for n, df in official.items())).filter("key <> ''")
    held = known.groupBy("key").agg(F.collect_set("source").alias("held"), *(F.min(c).alias(c) for c in LOOKS))
    seen = sightings.filter("key <> ''")
    last = seen.groupBy("key").agg(F.count("*").alias("sightings"), F.max(F.struct("seen_at", "seen_where")).alias("last"))
    votes = majority(seen.filter(F.col("ocr_confidence") >= SPEAKS), "key", [f"observed_{c}" for c in LOOKS])
    looks = votes.groupBy("key").agg(*(F.max(F.when(F.col("column") == f"observed_{c}", F.col("value"))).alias(f"_{c}") for c in LOOKS))
    out = held.join(last, "key", "full").join(looks, "key", "left").filter(F.col("held").isNotNull() | is_valid(F.col("key")))
    names = F.concat(F.coalesce("held", F.array().cast("array<string>")), F.when(F.col("sightings") > 0, F.array(F.lit(camera))).otherwise(F.array().cast("array<string>")))
    first = F.filter(names, lambda s: s == identity)
    out = out.withColumn("sources", F.concat(first, F.array_sort(F.filter(names, lambda s: s != identity))))
    registered = F.array_contains("sources", identity)
    filled = F.filter(F.array(*(F.when(F.col(c).isNull() & F.col(f"_{c}").isNotNull(), c) for c in LOOKS)), lambda c: c.isNotNull())
    list_ = F.array_join("sources", ", ")
    return out.select(
        "key", "sources", registered.alias("registered"), F.when(F.col("held").isNull(), CAMERA_ONLY).otherwise(1.0).alias("prior"), *(F.coalesce(c, f"_{c}").alias(c) for c in LOOKS), filled.alias("fingerprint"),
        F.coalesce("sightings", F.lit(0)).alias("sightings"), F.col("last.seen_at").alias("seen_at"), F.col("last.seen_where").alias("seen_where"), F.when(registered, list_).otherwise(F.concat(F.lit("not registered; known to "), list_)).alias("held_by"),
    )
