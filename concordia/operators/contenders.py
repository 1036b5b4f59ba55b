"""Contenders for the same reads held against each other, and a stacked model of all of them.

Keys, not rows, are dealt into parts and folds by a hash, so no read of a key that is judged was trained on. What a stacked
model learns from is out of fold: each base model scores the keys of a fold by what the other folds taught it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate, matching

PARTS = (("train", 60), ("validation", 80), ("test", 100))
FOLDS, PRECISION = 5, 0.98


def part_of(key: Column) -> Column:
    """train, validation or test: 60, 20 and 20 of 100 keys, the same for all rows of a key."""
    bucket = F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") % 100
    out = F.lit(None).cast("string")
    for name, below in reversed(PARTS):
        out = F.when(bucket < below, name).otherwise(out)
    return out


def fold_of(key: Column, folds: int = FOLDS) -> Column:
    return (F.conv(F.substring(F.md5(key), 5, 4), 16, 10).cast("int") % folds).cast("int")


def scored(model, rows: DataFrame, name: str) -> DataFrame:
    """rows with the model's probability as a column."""
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).select(*rows.columns, name)


def cross_fit(rows: DataFrame, features: list[str], name: str, key: str, label: str = "label", kind: str = "logreg", folds: int = FOLDS) -> DataFrame:
    """rows with ``name``: each row's probability by a model that has seen no row of its key's fold. A fixed number of models, whatever the rows."""
    own = rows.withColumn("_fold", fold_of(F.col(key), folds))
    parts = []
    for k in range(folds):
        rest = own.filter(F.col("_fold") != k)
        parts.append(scored(matching.train(rest, features, kind, label), own.filter(F.col("_fold") == k), name))
    return reduce(DataFrame.unionByName, parts).drop("_fold")


def stack(rows: DataFrame, bases: dict[str, tuple[list[str], str]], more: list[str], key: str, label: str = "label", name: str = "stacked") -> DataFrame:
    """rows (with ``part``) with a probability of each base (name: features, kind) and of the model stacked on them and the features ``more``.

    Training rows have the bases' out-of-fold probabilities, the others those of bases fitted on all training rows.
    """
    train, rest = rows.filter("part = 'train'"), rows.filter("part <> 'train'")
    for base, (features, kind) in bases.items():
        model = matching.train(train, features, kind, label)
        train, rest = cross_fit(train, features, base, key, label, kind), scored(model, rest, base)
    last = matching.train(train, [*bases, *more], "logreg", label)
    return scored(last, train, name).unionByName(scored(last, rest, name))


def compare(rows: DataFrame, reads: DataFrame, contenders: list[str], precision: float = PRECISION, by: str = "case_id") -> DataFrame:
    """(contender, n, top1, mrr, threshold, accept_precision, accept_recall) over the test part of reads (case_id, part), those without a candidate included.

    rows: case_id, part, key, label (1: the true key) and a score of each contender. A contender accepts its first key (ties by key) from the
    least score on that reached the precision on the validation part; where none did it accepts nothing.
    """
    each = rows.filter("part <> 'train'").unpivot([by, "part", "key", "label"], contenders, "contender", "score")
    w = Window.partitionBy("contender", by).orderBy(F.desc("score"), "key")
    ranked = each.withColumn("rank", F.row_number().over(w))
    first = ranked.filter("rank = 1")
    levels = [evaluate.threshold(first.filter((F.col("part") == "validation") & (F.col("contender") == c)), "score", "label", precision).select(F.lit(c).alias("contender"), "threshold") for c in contenders]
    levels = reduce(DataFrame.unionByName, levels)
    n = reads.filter("part = 'test'").agg(F.count("*").alias("n")).first()["n"]  # one number
    of = F.lit(max(n, 1))
    found = ranked.filter("part = 'test' and label = 1").groupBy("contender").agg((F.count_if(F.col("rank") == 1) / of).alias("top1"), (F.sum(1 / F.col("rank")) / of).alias("mrr"))
    took = first.filter("part = 'test'").join(F.broadcast(levels), "contender").groupBy("contender").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("_taken"), F.count_if((F.col("score") >= F.col("threshold")) & (F.col("label") == 1)).alias("_right"), F.first("threshold").alias("threshold"))
    out = took.join(found, "contender", "left").withColumns({"n": F.lit(n), "top1": F.coalesce("top1", F.lit(0.0)), "mrr": F.coalesce("mrr", F.lit(0.0))})
    share = F.when(F.col("_taken") > 0, F.col("_right") / F.col("_taken")).otherwise(0.0)
    return out.select("contender", "n", "top1", "mrr", "threshold", share.alias("accept_precision"), (F.col("_right") / of).alias("accept_recall"))


def unlabelled(reads: DataFrame, registry: DataFrame, truth: str = "truth", key: str = "key") -> DataFrame:
    """Reads of keys that no source holds: no contender can be right about them, and an open-world check must refuse them."""
    return reads.join(registry.select(F.col(key).alias("_k")).distinct(), F.col(truth) == F.col("_k"), "left_anti")
