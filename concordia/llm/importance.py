"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams, one of target text (labelled good) and one of raw text (all
documents), give each document a log ratio. Gumbel noise added to it and the k largest sums taken is a sample
without replacement in proportion to the ratio. As a classifier, the mean log ratio per n-gram against a
threshold that is fitted on labelled rows held out of the target model says what is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, kept, mix, prefix_hash, span_hash, texts, word_hashes, words

#: Hash buckets of a model: what the driver and the tasks hold of the corpus, whatever its size.
BUCKETS = 1 << 16
SHARE = 0.5
SEED = 8
_BINS = 1 << 12
#: Rows that are ranked in one task to find the last ones of a sample.
_FEW = 10_000


def features(column: pa.Array):
    """Of each few rows: (first row, bucket of each n-gram, row of each n-gram). n-grams: words, word pairs, and the words' last character with the next's first."""
    data, offsets = texts(column)
    for i, j in chunks(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, first = words(part, offsets[i : j + 1] - offsets[i])
        h = word_hashes(part, starts, ends)
        row = np.repeat(np.arange(j - i), np.diff(first))
        pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
        tail = mix(part[ends - 1].astype(np.uint64) + (part[starts].astype(np.uint64) << np.uint64(8)) + np.uint64(1 << 40))
        grams = np.concatenate([h, span_hash(prefix_hash(h), pair, pair + 2), tail])
        yield i, j, (grams >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.concatenate([row, row[pair], row])


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """All labelled ids: (id, good, fold); fold 0 fits the model, fold 1 the threshold."""
    own = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("good")).filter("_id is not null and good is not null")
    return own.withColumn("fold", F.pmod(F.xxhash64("_id", F.lit(SEED + 1)), F.lit(2)))


def cut_of(seen: DataFrame, few: int = _FEW) -> float:
    """The cut on ``mean`` that gives the best mean of the recalls of good (1) and bad (0) rows, exactly; of equal ones the lowest between two values, or
    below all of them if nothing is better than that. Minus infinity without rows of both kinds.

    Different values are counted and put in order in ranges, so neither the driver nor a task holds them all.
    """
    totals = {r["good"]: r["count"] for r in seen.filter("good in (0, 1)").groupBy("good").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return -np.inf
    counted = seen.filter("good in (0, 1)").groupBy("mean").agg(F.count_if(F.col("good") == 1).alias("g"), F.count_if(F.col("good") == 0).alias("b"))
    n = max(1, -(-sum(totals.values()) // few))
    # what a range begins with is the sum of those before, of which there are few
    ranged = kept(counted.repartitionByRange(n, "mean").withColumn("part", F.spark_partition_id()))
    sums, at, low = {}, [0, 0], None
    for r in ranged.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.min("mean").alias("low")).orderBy("part").collect():
        sums[r["part"]] = tuple(at)
        at = [at[0] + r["g"], at[1] + r["b"]]
        low = r["low"] if low is None else min(low, r["low"])
    start = lambda i: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p, v in sums.items() for x in (p, v[i]))), F.col("part")), F.lit(0))
    before = Window.partitionBy("part").orderBy("mean").rowsBetween(Window.unboundedPreceding, -1)
    edges = ranged.select("part", "mean", F.lag("mean").over(Window.partitionBy("part").orderBy("mean")).alias("last"), *((F.coalesce(F.sum(c).over(before), F.lit(0)) + start(i)).alias(f"{c}0") for i, c in enumerate("gb")))
    ends = {r["part"]: r["high"] for r in ranged.groupBy("part").agg(F.max("mean").alias("high")).collect()}
    order = sorted(ends)
    previous = F.create_map(*(F.lit(x) for a, b in zip(order[1:], order) for x in (a, ends[b]))) if len(order) > 1 else None
    if previous is not None:
        edges = edges.withColumn("last", F.coalesce("last", F.try_element_at(previous, F.col("part"))))
    # as in whole numbers: recall of good ones that stay, and of bad ones that go
    value = (1 - F.col("g0") / totals[1]) + F.col("b0") / totals[0]
    middle = (F.col("mean") + F.col("last")) / 2  # not above the lower of two values that are next to each other
    best = edges.filter("last is not null").select(F.when(middle > F.col("last"), middle).otherwise(F.col("mean")).alias("cut"), value.alias("value")).orderBy(F.desc("value"), "cut").first()
    return float(best["cut"]) if best and best["value"] >= 1 else float(low - 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """The log ratio of each bucket (of the target's share to the raw text's) and the threshold on a document's mean.

    Raw counts are over all documents. The threshold gives the best mean of the two classes' recalls on fold 1;
    without labels of both kinds everything is kept (threshold minus infinity). All labelled rows count; driver and tasks hold BUCKETS
    numbers, and the ids of the target's rows.
    """
    chosen = labelled(labels, id_col, label_col)
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            target = np.array([bool(x) for x in b.column(1).to_pylist()], bool)
            for i, j, bucket, row in features(b.column(0)):
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[target[i:j][row]], minlength=BUCKETS)
        kind, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(bucket, pa.int64()), pa.array(total[kind, bucket])], names=["kind", "bucket", "n"])

    # only the target's ids are sent to all, whatever their number: no text is shuffled
    own = F.broadcast(chosen.filter("good = 1 and fold = 0").select("_id", F.lit(True).alias("target")))
    marked = base.join(own, "_id", "left").select("_text", F.coalesce("target", F.lit(False)).alias("target"))
    totals = np.zeros((2, BUCKETS))
    for r in marked.mapInArrow(count, "kind long, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        totals[r["kind"], r["bucket"]] = r["n"]
    # the raw model also smooths the target's: as many n-grams as there are buckets, drawn from it
    raw = (totals[0] + 1) / (totals[0].sum() + BUCKETS)
    target = (totals[1] + BUCKETS * raw) / (totals[1].sum() + BUCKETS)
    weights = np.log(target / raw) if totals[1].sum() else np.zeros(BUCKETS)
    return weights, cut_of(kept(score(base, weights, ["_id"], "_text").select("_id", "mean").join(chosen.filter("fold = 1"), "_id").select("good", "mean")))


def score(docs: DataFrame, weights: np.ndarray, carry: list[str], text_col: str = "text") -> DataFrame:
    """carry, ``log_ratio`` (the sum over a text's n-grams) and ``mean`` (by n-gram); 0 for null and blank texts."""

    def run(batches):
        for b in batches:
            total, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for i, j, bucket, row in features(b.column(b.num_columns - 1)):
                total[i:j] = np.bincount(row, weights[bucket], minlength=j - i)
                n[i:j] = np.bincount(row, minlength=j - i)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(total), pa.array(total / np.maximum(n, 1))], names=[*b.schema.names[:-1], "log_ratio", "mean"])

    d = docs.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{text_col}`").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(run, f"{fields}, log_ratio double, mean double")


def top_k(df: DataFrame, column: str, k: int, tie: str, few: int = _FEW) -> DataFrame:
    """df with ``selected``: whether the row is among the k largest of a column (ties by another), exactly, for any k.

    Values are counted in bins, then those of the bin that the k-th value falls in, and so on, until at most ``few`` rows or
    one value are left between the bounds: what is above is taken, and only what is between them is ranked.
    Null values come last.
    """
    low, high, left = *df.agg(F.min(column), F.max(column)).first(), k
    if low is None or k <= 0:
        return df.withColumn("selected", F.lit(False))
    value = F.coalesce(F.col(column), F.lit(low))
    inside = (value >= F.lit(low)) & (value <= F.lit(high))
    while True:
        width = (high - low) / _BINS
        place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(_BINS - 1)) if width > 0 else F.lit(0)
        bins = df.filter(inside).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).orderBy(F.desc("bin")).collect()
        for edge in bins:
            if left <= edge["n"]:
                break
            left -= edge["n"]
        else:
            return df.withColumn("selected", F.lit(True))
        low, high = edge["low"], edge["high"]
        inside = (value >= F.lit(low)) & (value <= F.lit(high))
        if edge["n"] <= few or low == high:
            break
    ranked = df.filter(inside).withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(value), tie)))
    return df.filter(~inside).withColumn("selected", value > F.lit(high)).unionByName(ranked.withColumn("selected", F.col("_rank") <= left).drop("_rank"))


def gumbel(id_col: str, seed: int = SEED):
    """Gumbel noise of a row, from a hash of its id: reruns agree."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float = SHARE, seed: int = SEED) -> DataFrame:
    """id, log_ratio, mean, kept (the classifier's verdict), gumbel_key and selected (a sample of ``share`` of the rows).

    The key uses the log ratio itself, so rows are drawn in proportion to their importance weight; the mean only says
    what is kept. Null and blank texts have ratio 0 and aren't kept if that's below
    the threshold. Rows of equal ids share their noise; other columns aren't read.
    """
    weights, cut = fit(docs, labels, id_col, text_col, label_col)
    scored = score(docs, weights, [id_col], text_col)
    keyed = kept(scored.withColumns({"kept": F.col("mean") >= F.lit(cut), "gumbel_key": F.col("log_ratio") + gumbel(id_col, seed)}))
    return top_k(keyed, "gumbel_key", int(share * keyed.count()), id_col)
