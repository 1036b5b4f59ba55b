"""What each way of finding candidates keeps and costs, and the number of edits to allow for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.functions.similarity import qgrams
from concordia.functions.transforms import norm_plate

from . import blocking

# The recall wanted, and how far below the best one may be where that can't be had.
WANTED, SLACK = 0.99, 0.005
EDITS = (1, 2, 3, 4, 5)


#: Ways that keep the same pairs.
EXACT = ("size", "prefix", "position")


def retrieval(reads: DataFrame, registry: DataFrame, key: str = "key", strategies: tuple[str, ...] = ("prefix", "position"), edits: tuple[int, ...] = EDITS, q: int = 2) -> DataFrame:
    """(strategy, edits, part, n, recall, mean_candidates) of reads (read, truth, part); all rows count, a read that stands twice twice.

    ``none`` (0 edits), all registered keys, is counted without making the pairs: it finds each read's key if that is registered, and costs as
    many candidates as there are keys. An empty or null read finds nothing, at the cost of none, whatever the strategy. The strategies
    of ``EXACT`` keep the same pairs for a number of edits, and fewer edits keep some of those of more; so the candidates of each different read are found
    once, for the most edits, and counted for all. ``index``, which has no such bound, isn't measured.
    """
    if not {*strategies} <= {*EXACT}:
        raise ValueError(f"only {', '.join(EXACT)} can be measured")
    own = reads.select(F.coalesce(norm_plate(F.col("read")), F.lit("")).alias("read"), norm_plate(F.col("truth")).alias("truth"), "part")
    rows = own.groupBy("read", "truth", "part").agg(F.count("*").alias("n"))
    keys = registry.select(norm_plate(F.col(key)).alias("key")).filter("key <> ''").distinct()
    held = keys.select(F.col("key").alias("truth"), F.lit(1).alias("_in"))
    total = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")

    def measured(each: DataFrame) -> DataFrame:
        return each.groupBy("edits", "part").agg(F.sum("n").alias("n"), total("hit").alias("recall"), total("cost").alias("mean_candidates"))

    there = F.col("read") != ""
    full = rows.join(held, "truth", "left").crossJoin(F.broadcast(keys.agg(F.count("*").alias("_all"))))
    none = full.withColumns({"edits": F.lit(0), "hit": F.when(there, F.coalesce("_in", F.lit(0))).otherwise(0), "cost": F.when(there, F.col("_all")).otherwise(0)})
    # the fewest edits that keep each pair
    tokens = lambda c: F.size(F.array_distinct(qgrams(F.col(c), q)))
    x, y = tokens("read"), tokens("key")
    asked = F.array(*(F.lit(k) for k in sorted(edits)))
    enough = lambda k: (F.abs(x - y) <= q * k) & (F.col("shared") >= F.greatest(F.lit(1), F.greatest(x, y) - q * k))
    pairs = blocking.candidates(own, "read", registry, key, "position", max(edits), q).select("read", "key", F.explode(F.filter(asked, enough)).alias("edits"))
    cost = pairs.groupBy("read", "edits").agg(F.count("*").alias("cost"))
    hit = pairs.withColumnRenamed("key", "truth").join(rows.select("read", "truth").distinct(), ["read", "truth"], "left_semi").withColumn("hit", F.lit(1))
    each = rows.withColumn("edits", F.explode(asked)).join(cost, ["read", "edits"], "left").join(hit, ["read", "truth", "edits"], "left")
    found = measured(each.withColumns({"hit": F.coalesce("hit", F.lit(0)), "cost": F.coalesce("cost", F.lit(0))}))
    named = found.withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))
    return measured(none).withColumn("strategy", F.lit("none")).unionByName(named).select("strategy", "edits", "part", "n", "recall", "mean_candidates")


def choose_edits(table: DataFrame, strategy: str = "position", part: str = "validation", wanted: float = WANTED, slack: float = SLACK) -> DataFrame:
    """One row, edits and reached: the fewest edits whose recall on that part is as wanted; where none is, the fewest within ``slack`` of the best, and reached is false."""
    own = table.filter((F.col("strategy") == strategy) & (F.col("part") == part))
    best = own.agg(F.max("recall").alias("best"), F.min(F.when(F.col("recall") >= wanted, F.col("edits"))).alias("_edits"))
    near = own.crossJoin(F.broadcast(best)).filter(F.col("recall") >= F.col("best") - slack)
    return near.agg(F.coalesce(F.min("_edits"), F.min("edits")).alias("edits"), F.max(F.col("_edits").isNotNull()).alias("reached"))
