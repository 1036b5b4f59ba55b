"""Evaluation of scores and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratios(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two 0/1 columns; a ratio without a base is 0."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    out = df.agg(count(p & a).alias("tp"), count(p & ~a).alias("fp"), count(~p & a).alias("fn"))
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def ranking(ranks: DataFrame) -> DataFrame:
    """top1, top5 and mrr of reads' true ranks (null: not found)."""
    r = F.col("rank")
    return ranks.agg(F.avg(F.coalesce((r == 1).cast("int"), F.lit(0))).alias("top1"), F.avg(F.coalesce((r <= 5).cast("int"), F.lit(0))).alias("top5"), F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"))


def calibration(df: DataFrame, p: str, actual: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, share): what probabilities of a bin come to."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(actual).cast("double")).alias("share"))


def ece(df: DataFrame, p: str, actual: str, bins: int = 10) -> DataFrame:
    c = calibration(df, p, actual, bins)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n")).alias("ece"))


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """b01 and b10, rows that only the second, or only the first, of two 0/1 outcomes gets right, and p_value: the exact two-sided one.

    The smaller count's tail of the binomial with an even chance, twice, 1 at most; summed by logarithms of its terms. Of a long tail only the terms
    within ten standard deviations and a bit of its end are summed: the others are less than 1e-80 of the last, so the work grows with the root of the counts.
    """
    one = lambda x, y: F.sum(F.when((F.col(a) == x) & (F.col(b) == y), 1).otherwise(0))
    out = df.agg(F.coalesce(one(0, 1), F.lit(0)).alias("b01"), F.coalesce(one(1, 0), F.lit(0)).alias("b10"))
    n, k = F.col("b01") + F.col("b10"), F.least("b01", "b10")
    least = F.greatest(F.lit(0), k - 64 - F.ceil(10 * F.sqrt(n))).cast("long")
    first = _log_factorial(n) - _log_factorial(least) - _log_factorial(n - least) - n * F.log(F.lit(2.0))
    start = F.struct(first.alias("term"), F.exp(first).alias("sum"))

    def more(s, i):
        term = s["term"] + F.log((n - i + 1) / i)
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    places = F.when(k > least, F.sequence(least + 1, k)).otherwise(F.array().cast("array<bigint>"))
    return out.withColumn("p_value", F.least(F.lit(1.0), 2 * F.aggregate(places, start, more, lambda s: s["sum"])))


def _log_factorial(n: Column) -> Column:
    """log n!, by Stirling's series eight places up, where it is good to 1e-11."""
    z = n + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return F.when(n == 0, 0.0).otherwise(series - sum((F.log(n + float(i)) for i in range(1, 9)), F.lit(0.0)))


#: Bins, and bins of each bin, in which distinct values are summed before any running total; only their sums are ordered in one task.
BINS = 4096


def _running(counted: DataFrame, value: str, sums: list[str], descending: bool) -> DataFrame:
    """Rows of distinct values with the running total of each of ``sums``: within bins of equal width, on top of the bins before.

    Each bin is cut again into bins of its own extent, so that a few far values don't leave all others in one.
    """
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    place = (F.col(value) - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300)) * BINS
    cut = lambda df, name: df.withColumn(name, F.least(F.floor(place), F.lit(BINS - 1)).cast("int")).drop("_low", "_high")
    ends = [F.min(value).alias("_low"), F.max(value).alias("_high")]
    wide = cut(counted.crossJoin(F.broadcast(counted.agg(*ends))), "_bin")
    # at most BINS rows
    fine = cut(wide.join(F.broadcast(wide.groupBy("_bin").agg(*ends)), "_bin"), "_part")

    def before(within: list[str], by: str, name: str) -> DataFrame:
        earlier = Window.partitionBy(*(within or [F.lit(0)])).orderBy(order(by)).rowsBetween(Window.unboundedPreceding, -1)
        return fine.groupBy(*within, by).agg(*(F.sum(c).alias(c) for c in sums)).select(*within, by, *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{name}{c}") for c in sums))

    inside = Window.partitionBy("_bin", "_part").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = fine.join(before(["_bin"], "_part", "_part_"), ["_bin", "_part"]).join(F.broadcast(before([], "_bin", "_bin_")), "_bin")
    return out.select(value, *sums, *((F.col(f"_bin_{c}") + F.col(f"_part_{c}") + F.sum(c).over(inside)).alias(f"run_{c}") for c in sums))


def threshold(df: DataFrame, p: str, actual: str, precision: float) -> DataFrame:
    """The lowest score from which on the rows above have the wanted precision. Scores are counted first, then accumulated; null scores count nowhere."""
    by = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(actual).cast("long")).alias("good"))
    return _running(by, "score", ["n", "good"], True).filter(F.col("run_good") / F.col("run_n") >= precision).agg(F.min("score").alias("threshold"))


def confusions(pairs: DataFrame, truth: str, read: str) -> DataFrame:
    """(a, b, n): characters that stand for each other at equal places of texts of equal length, either way round."""
    same = pairs.filter((F.length(truth) == F.length(read)) & (F.col(truth) != F.col(read)))
    at = same.select(F.explode(F.arrays_zip(F.split(truth, "").alias("x"), F.split(read, "").alias("y"))).alias("z")).select("z.x", "z.y").filter("x <> y")
    return at.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))


def learned_costs(counts: DataFrame) -> DataFrame:
    """cost = max(0.1, 1 - log(1 + n) / log(1 + largest n)); (a, b, n) of one row a pair of characters."""
    most = counts.agg(F.max("n").alias("m"))
    return counts.crossJoin(F.broadcast(most)).select("a", "b", "n", F.greatest(F.lit(0.1), 1 - F.log1p("n") / F.log1p("m")).alias("cost"))


def stratified(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """n rows in turns from each class: first ones first, classes by their first row."""
    w = Window.partitionBy(*by)
    ranked = df.withColumns({"turn": F.row_number().over(w.orderBy(order)), "class_first": F.min(order).over(w)}).filter(F.col("turn") <= n)
    return ranked.orderBy("turn", "class_first").limit(n)


def percentiles(df: DataFrame, column: str, shares=(0.5, 0.95)) -> DataFrame:
    """Exact percentiles, between two values in proportion; null values count nowhere, of none each is null."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    runs = _running(counted, "v", ["n"], False).crossJoin(F.broadcast(total))
    place = lambda p: p * (F.col("total") - 1)
    at = lambda rank: F.min(F.when(F.col("run_n") > rank, F.col("v")))
    ends = [x for i, p in enumerate(shares) for x in (at(F.floor(place(p))).alias(f"a{i}"), at(F.ceil(place(p))).alias(f"b{i}"), F.max(place(p) - F.floor(place(p))).alias(f"f{i}"))]
    return runs.agg(*ends).select(*((F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}")).alias(f"p{round(100 * p)}") for i, p in enumerate(shares)))


def bootstrap(df: DataFrame, column: str, key: str, replicas: int = 100, seed: int = 1) -> DataFrame:
    """2.5 and 97.5 percentiles of a mean over Poisson resamples, whose weights come from hashes of key and replica.

    Each row meets every replica (a fixed number), and is summed before anything is shuffled.
    """
    u = (F.pmod(F.xxhash64(F.col(key), F.col("replica"), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # the Poisson distribution of mean 1, cut at 6
    bounds = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = sum((F.when(u > b, 1).otherwise(0) for b in bounds), F.lit(0))
    drawn = df.select(key, column, F.explode(F.sequence(F.lit(1), F.lit(replicas))).alias("replica")).withColumn("w", weight)
    means = drawn.groupBy("replica").agg((F.sum(F.col(column) * F.col("w")) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
