"""Mixing sources to target weights under weight schedules that vary over training.

A source's schedule is a straight line from start to end; its integral is the source's share of the
tokens. A source can't be asked for more than ``epochs`` times what it has: the rest is shared among
the others by weight, until none is above (water-filling, solved in closed form). A document's
training position is where its source's cumulative demand reaches it, so documents sorted by position
follow the schedules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCHS = 3
WEIGHTS = (5, 2, 1)
#: How a source's weight moves over training: start and end as multiples of its mean, by its place in the weights.
SLOPES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size, weight, and more) with ``target``, as double.

    The level is the largest, over the sources taken in order of cap / weight, of what is left of the total above
    the caps so far by the weights left: the demands min(cap, level * weight) then sum to the total.
    One row per source is ranked, no documents.
    """
    cap = F.col("source_size") * epochs
    order = Window.orderBy(cap / F.col("weight"), "weight", "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = sizes.withColumn("_level", left.cast("double") / weights.cast("double"))
    return levels.withColumn("target", F.least(cap.cast("double"), F.max("_level").over(everything) * F.col("weight"))).drop("_level")


def position(demand: Column, start: Column, end: Column) -> Column:
    """The time, 0 to 1, by which a schedule from start to end has asked for this share of its total."""
    area = (start + end) / 2 * demand
    bend = (end - start) / 2
    root = F.sqrt(F.greatest(start * start + 4 * bend * area, F.lit(0.0)))
    return F.when(area <= 0, 0.0).otherwise(F.least(F.lit(1.0), 2 * area / (start + root)))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry=None, weights=WEIGHTS, slopes=SLOPES, epochs: int = EPOCHS) -> DataFrame:
    """One row per row of docs: ``row`` (a struct of the columns in carry, by default all) and

    size, source_size, taken (words; repeats counted), target (its source's), passes (whole epochs of its source),
    ahead (words of its source before it), goal (the target as whole words), slope_from, slope_to, first_position.

    Within a source documents stand in the order of the md5 of their id, then id, then the text's hash. Of each source
    whole passes are taken, then its documents in order up to the target; the last one taken may be taken in part.
    Rows without text have size 0 and take nothing; a null source is a source, the last; each of some equal rows has
    a turn of its own; no table, no rows. What docs calls its columns makes no difference, as they stay in ``row``.
    Sums run over (source, first digits of the md5) before any running total, so no task sees a whole source.
    """
    col = lambda x: F.col(f"`{x}`")
    order = F.md5(F.coalesce(col(id_col).cast("string"), F.lit("")))
    source = [F.coalesce(col(source_col), F.lit("")).alias("s"), col(source_col).isNull().alias("none"), F.substring(order, 1, _DIGITS).alias("slice")]
    base = docs.select(F.struct(*map(col, docs.columns if carry is None else carry)).alias("row"), *source, n_words(col(text_col)).alias("size"), F.struct(order.alias("o"), col(id_col).alias("i"), F.xxhash64(col(text_col)).alias("h")).alias("turn"))
    key = ["none", "s", "slice"]
    slices = docs.select(*source, n_words(col(text_col)).alias("size")).groupBy(*key).agg(F.sum("size").alias("sum"))
    within = Window.partitionBy("none", "s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("sum").over(within), F.lit(0)))
    place = ((F.row_number().over(Window.orderBy("none", "s")) - 1) % len(weights)).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("place") + 1)
    sizes = slices.groupBy("none", "s").agg(F.sum("sum").alias("source_size")).withColumn("place", place).withColumn("weight", pick(weights))
    goal = targets(sizes.withColumn("source", F.struct("none", "s")), epochs)
    goal = goal.select("none", "s", "source_size", "target", F.round("target").cast("long").alias("goal"), pick([float(a) for a, _ in slopes]).alias("slope_from"), pick([float(b) for _, b in slopes]).alias("slope_to"))
    goal = goal.withColumn("passes", F.expr("goal div greatest(source_size, 1)"))
    plan = slices.select(*key, "before").join(goal, ["none", "s"])
    run = Window.partitionBy(*key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    out = base.withColumn("ahead", F.coalesce(F.sum("size").over(run), F.lit(0))).join(plan, key).withColumn("ahead", F.col("before") + F.col("ahead"))
    rest = F.col("goal") - F.col("passes") * F.col("source_size")
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead")))
    out = out.withColumn("taken", taken)
    return out.select("row", "size", "source_size", "taken", "target", "passes", "ahead", "goal", "slope_from", "slope_to", at(F.lit(0)).alias("first_position"))


def at(copy: Column) -> Column:
    """The position of a copy (from 0) of a row that mix() returned."""
    demand = (copy * F.col("source_size") + F.col("ahead") + F.col("size") / 2) / F.greatest(F.col("goal"), F.lit(1))
    return position(F.least(demand, F.lit(1.0)), F.col("slope_from"), F.col("slope_to"))


def sequence(mixed: DataFrame) -> DataFrame:
    """The copies that a mix takes, sorted by position: ``row``, ``copy``, ``position`` and ``words`` (of this copy)."""
    copies = F.expr("cast(ceil(taken / greatest(size, 1)) as int)")
    out = mixed.filter("taken > 0").select("*", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    out = out.select("row", "copy", at(F.col("copy")).alias("position"), words.alias("words"))
    return out.repartitionByRange("position").sortWithinPartitions("position", "copy")
