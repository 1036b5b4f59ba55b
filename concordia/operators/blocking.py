"""Candidate pairs of a noisy read and registered keys by shared q-grams, instead of all pairs.

size, prefix and position keep every key within ``edits`` edits of the read, by sets of its rarest tokens. An index is the registry's exploded tokens in a global order, rarest first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.similarity import CONFUSABLE, qgrams
from concordia.functions.transforms import norm_plate

STRATEGIES = ("none", "index", "size", "prefix", "position")
# Fixed value: by how many tokens at once a pair is met, where it must have as many in common.
TOGETHER = 3
# Keys and reads that meet in a task at once.
KEYS, READS = 1 << 15, 1 << 9


def tokens(df: DataFrame, key: str, q: int = 2) -> DataFrame:
    """(key, token): the distinct q-grams of each different key."""
    return df.select(norm_plate(F.col(key)).alias("key")).filter("key <> ''").distinct().select("key", F.explode(F.array_distinct(qgrams(F.col("key"), q))).alias("token"))


def index(registry: DataFrame, key: str, q: int = 2) -> DataFrame:
    """(key, token, df, pos, n): the registry's tokens, how many keys have each, its place among the key's tokens by (df, token)."""
    t = tokens(registry, key, q)
    return _placed(t.join(_few(t.groupBy("token").agg(F.count("*").alias("df")), q), "token"))


def _few(by_token: DataFrame, q: int) -> DataFrame:
    """Rows of a token each: short ones are few, whatever the keys, and sent to all; the keys' own tokens, many times what their table's size tells, never are."""
    return by_token.hint("broadcast" if q <= 3 else "merge")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df by some columns over a fixed number of tasks: pairs are few bytes, of which Spark would make one task, but comparing them is dear."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def _placed(t: DataFrame) -> DataFrame:
    order = Window.partitionBy("key").orderBy("df", "token")
    return dealt(t, "key").select("key", "token", "df", F.row_number().over(order).alias("pos"), F.count("*").over(Window.partitionBy("key")).alias("n"))


def probe(reads: DataFrame, read: str, indexed: DataFrame, q: int = 2) -> DataFrame:
    """The reads' tokens in the index's order; tokens that it lacks have df 0 and so come first."""
    known = indexed.select("token", "df").distinct()
    return _placed(tokens(reads, read, q).join(_few(known, q), "token", "left").withColumn("df", F.coalesce("df", F.lit(0))))


def _coded(tokens: Column, q: int) -> Column:
    """Tokens as numbers, which are met faster and take less: their own bytes, so that no two are one; texts where they don't fit."""
    return F.transform(tokens, lambda t: F.conv(F.hex(t), 16, 10).cast("long")) if q <= 7 else tokens


def _signed(placed: DataFrame, together: int, least: Column, most: Column, lost: Column, q: int) -> DataFrame:
    """(key, n, _codes, sign): a hash of each set of L of a key's first L + ``lost`` tokens, for L from ``least`` to ``most``, at most ``together``.

    Two keys that have k >= L tokens in common have their first L of those among the first L + n - k of either, so they share a sign.
    """
    own = placed.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t")).withColumn("_t", F.col("_t.token"))
    levels = []
    for size in range(1, together + 1):
        front = F.slice(F.col("_t"), F.lit(1), F.greatest(F.lit(0), F.lit(size) + lost).cast("int"))
        own = own.withColumn(f"_f{size}", F.when((least <= size) & (most >= size), front).otherwise(F.array().cast("array<string>")))
        levels.append(_subsets(F.col(f"_f{size}"), size))
    return own.withColumn("_codes", _coded(F.col("_t"), q)).select("key", "n", "_codes", F.explode(F.concat(*levels)).alias("sign"))


def _subsets(tokens: Column, size: int) -> Column:
    """A hash of each set of ``size`` tokens."""
    at = F.transform(tokens, lambda t, i: F.struct(F.xxhash64(F.lit(size), t).alias("sign"), i.alias("last")))
    for _ in range(size - 1):
        at = F.flatten(F.transform(at, lambda s: F.transform(F.slice(tokens, s["last"] + 2, F.size(tokens)), lambda t, i: F.struct(F.xxhash64(s["sign"], t).alias("sign"), (s["last"] + 1 + i).alias("last")))))
    return F.transform(at, lambda s: s["sign"])


def candidates(reads: DataFrame, read: str, registry: DataFrame, key: str, strategy: str = "position", edits: int = 2, q: int = 2, min_overlap: int = 1) -> DataFrame:
    """(read, key, shared): pairs that may be within ``edits`` edits. An empty read has none.

    An edit changes q tokens at most, so such a pair has at least n - q * edits in common. Pairs are met by up to three tokens at
    once, rare ones first: a token that many keys have makes no pairs by itself, unless a pair may have nothing else in common.
    size, prefix and position name filters that keep the same pairs; all three take the one step here, and differ no more in what they touch.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "none":
        # the reads are the fixed query set of a comparison with all keys: for measuring what the others lose
        x = reads.select(norm_plate(F.col(read)).alias("read")).filter("read <> ''").distinct()
        y = registry.select(norm_plate(F.col(key)).alias("key")).filter("key <> ''").distinct()
        # a fixed number of tasks: keys are few bytes, of which Spark would make one task, but their pairs are many. Each text is cut up once
        parts = max(64, 4 * y.sparkSession.sparkContext.defaultParallelism)
        x = x.withColumn("_x", _coded(F.array_distinct(qgrams(F.col("read"), q)), q))
        y = y.repartition(parts, "key").withColumn("_y", _coded(F.array_distinct(qgrams(F.col("key"), q)), q))
        return x.crossJoin(y).select("read", "key", F.size(F.array_intersect("_x", "_y")).cast("long").alias("shared"))
    y = index(registry, key, q)
    x = probe(reads, read, y, q)
    slack, n = q * edits, F.col("n")
    if strategy == "index":
        together = max(1, min(TOGETHER, min_overlap))
        least = most = F.when(n >= min_overlap, together).otherwise(0)
        lost, bound, near = n - max(1, min_overlap), F.lit(max(1, min_overlap)), F.lit(True)
    else:
        # C(together + slack, together) signs a key
        together = TOGETHER if slack <= 4 else 2
        least, most = F.least(F.lit(together), F.greatest(F.lit(1), n - slack)), F.least(F.lit(together), n)
        lost, bound, near = F.lit(slack), F.greatest(F.lit(1), F.greatest("nx", "ny") - slack), F.abs(F.col("nx") - F.col("ny")) <= slack
    a = _signed(x, together, least, most, lost, q).select(F.col("key").alias("read"), F.col("n").alias("nx"), F.col("_codes").alias("_x"), "sign")
    b = _signed(y, together, least, most, lost, q).select("key", F.col("n").alias("ny"), F.col("_codes").alias("_y"), "sign")
    # the registry's side is many times what its table's size tells, so neither side is sent to the driver
    pairs = a.hint("merge").join(b, "sign").filter(near)
    # what a pair has in common is told by its two sides' tokens, cut up once each: the index isn't read again
    shared = F.size(F.array_intersect("_x", "_y")).cast("long")
    return pairs.select("read", "key", shared.alias("shared"), bound.alias("_least")).filter(F.col("shared") >= F.col("_least")).select("read", "key", "shared").distinct()


def retrieve(reads: DataFrame, read: str, registry: DataFrame, key: str, edits: int = 2, q: int = 2, most: int | None = None) -> DataFrame:
    """Candidates; a read without any is tried again with one edit more, then by any shared token.

    most: of the keys that share any token, how many the caller ranks by Jaccard, ties by key; none but those are made then. Each step only runs for the reads that the one before left.
    """
    from .repair import kept

    every = kept(reads.select(norm_plate(F.col(read)).alias("read")).filter("read <> ''").distinct())
    # what the keys come from is read once
    registry = kept(registry.select(norm_plate(F.col(key)).alias(key)).filter(F.col(key) != "").distinct())
    found = kept(candidates(every, "read", registry, key, "position", edits, q))
    left = kept(every.join(found.select("read").distinct(), "read", "left_anti"))
    if left.isEmpty():
        return found
    more = kept(candidates(left, "read", registry, key, "position", edits + 1, q))
    found, last = found.unionByName(more), kept(left.join(more.select("read").distinct(), "read", "left_anti"))
    if last.isEmpty():
        return found
    return found.unionByName(candidates(last, "read", registry, key, "index", edits, q) if most is None else nearest(last, "read", registry, key, most, q))


def nearest(reads: DataFrame, read: str, registry: DataFrame, key: str, most: int, q: int = 2) -> DataFrame:
    """(read, key, shared): for each read the ``most`` keys of highest Jaccard similarity, ties by key, of those that share a token with it: exactly.

    Each read meets each key, but as numbers: keys and reads go through the tasks in blocks of ``KEYS`` and ``READS``, a block's tokens list the keys that have them,
    and no more than ``most`` rows of a read leave a block.
    """
    spark = reads.sparkSession
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    sized = lambda df, c: df.select(norm_plate(F.col(c)).alias("text")).filter("text <> ''").distinct()

    def blocks(texts: DataFrame, size: int) -> tuple[DataFrame, int]:
        n = max(1, -(-texts.count() // size))
        row = F.struct("text", F.array_distinct(qgrams(F.col("text"), q)).alias("tokens"))
        held = texts.groupBy(F.pmod(F.xxhash64("text"), F.lit(n)).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
        return held.select("block", F.col("rows.text").alias("texts"), F.col("rows.tokens").alias("tokens")), n

    keys, n = blocks(sized(registry, key), KEYS)
    own, _ = blocks(sized(reads, read), READS)
    # a fixed number of tasks: blocks are few bytes, of which Spark would make few tasks
    parts = max(64, 4 * spark.sparkContext.defaultParallelism)
    met = own.select(F.col("texts").alias("_reads"), F.col("tokens").alias("_x"), F.explode(upto(n)).alias("block"))
    both = met.withColumn("_salt", F.pmod(F.xxhash64("_reads"), F.lit(8))).repartition(parts, "block", "_salt")
    salted = keys.withColumn("_salt", F.explode(upto(8))).repartition(parts, "block", "_salt")
    both = both.join(salted.hint("merge"), ["block", "_salt"]).select("_reads", "_x", "texts", "tokens")
    top = both.mapInArrow(lambda batches: _tops(batches, most), "read string, key string, shared long, jaccard double")
    w = Window.partitionBy("read").orderBy(F.desc("jaccard"), "key")
    return top.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).select("read", "key", "shared")


def _tops(batches, most: int):
    """For each row, a block of reads and one of keys in order, with their tokens: each read's keys of highest Jaccard similarity, the first of equal ones."""
    for b in batches:
        for i in range(b.num_rows):
            reads, x, keys, y = (b.column(c)[i].values for c in range(4))
            tokens = y.flatten().dictionary_encode()
            code = tokens.indices.to_numpy()
            size = np.diff(y.offsets.to_numpy())
            having = np.repeat(np.arange(len(keys)), size)[np.argsort(code, kind="stable")]
            ends = np.cumsum(np.bincount(code, minlength=len(tokens.dictionary)))
            place = {t: having[end - n : end] for t, end, n in zip(tokens.dictionary.to_pylist(), ends, np.diff(ends, prepend=0))}
            out: list[tuple] = []
            for at, own in enumerate(x.to_pylist()):
                lists = [place[t] for t in own if t in place]
                if not lists:
                    continue
                shared = np.bincount(np.concatenate(lists), minlength=len(keys))
                some = np.flatnonzero(shared)
                like = shared[some] / (len(own) + size[some] - shared[some])
                if len(some) > most:
                    last = np.partition(like, len(like) - most)[len(like) - most]
                    above = np.flatnonzero(like > last)
                    pick = np.concatenate([above, np.flatnonzero(like == last)[: most - len(above)]])
                    some, like = some[pick], like[pick]
                out.append((np.full(len(some), at), some, shared[some], like))
            if out:
                at, some, shared, like = map(np.concatenate, zip(*out))
                yield pa.RecordBatch.from_arrays([reads.take(pa.array(at)), keys.take(pa.array(some)), pa.array(shared, pa.int64()), pa.array(like, pa.float64())], names=["read", "key", "shared", "jaccard"])


def sql_prefilter(read: str, column: str) -> str:
    """A predicate that a source can run itself: the same first two characters and nearly the same length."""
    plate = "".join(c for c in (read or "").upper() if c.isascii() and c.isalnum())
    if not all(p.isidentifier() for p in column.split(".")):
        raise ValueError(f"not a column: {column!r}")
    if len(plate) < 2:
        return "1=1"
    text = f"UPPER(REPLACE(REPLACE({column}, '-', ''), ' ', ''))"
    return f"({text} LIKE '{plate[:2]}%' AND LENGTH({text}) BETWEEN {max(1, len(plate) - 1)} AND {len(plate) + 1})"


def variants(c: Column, limit: int | None = 12) -> Column:
    """The key and its versions with one confusable character replaced, at most ``limit`` (None: all), in order of place."""
    chars = F.split(c, "")
    options = F.create_map(*(F.lit(x) for k, v in CONFUSABLE.items() for x in (k, v)))
    at = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))

    def swap(i: Column) -> Column:
        other = F.coalesce(F.try_element_at(options, F.get(chars, i - 1)), F.lit(""))
        return F.transform(F.filter(F.split(other, ""), lambda o: o != ""), lambda o: F.concat(F.substring(c, F.lit(1), i - 1), o, F.substring(c, i + 1, F.length(c))))

    every = F.array_distinct(F.concat(F.array(c), F.flatten(F.transform(at, swap))))
    return every if limit is None else F.slice(every, 1, limit)


def readings(c: Column, limit: int = 64, replaced: int = 8) -> Column:
    """The key and its versions with one, two, ... up to ``replaced`` confusable characters replaced: fewest first, then by place; at most ``limit`` (512 at most)."""
    if not 1 <= limit <= 512:
        raise ValueError("a source takes 1 to 512 versions")
    options = F.create_map(*(F.lit(x) for k, v in CONFUSABLE.items() for x in (k, v)))

    def others(s: Column, i: Column) -> Column:
        signs = F.split(F.coalesce(F.try_element_at(options, F.substring(s["text"], i, F.lit(1))), F.lit("")), "")
        return F.transform(F.filter(signs, lambda o: o != ""), lambda o: F.struct(F.concat(F.substring(s["text"], F.lit(1), i - 1), o, F.substring(s["text"], i + 1, F.length(s["text"]))).alias("text"), i.cast("int").alias("last")))

    def further(s: Column) -> Column:
        places = F.when(s["last"] < F.length(s["text"]), F.sequence(s["last"] + 1, F.length(s["text"]))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(places, lambda i: others(s, i)))

    first = F.array(F.struct(c.alias("text"), F.lit(0).alias("last")))
    state = F.struct(first.alias("all"), first.alias("level"))

    def grow(acc: Column, _: Column) -> Column:
        level = F.slice(F.flatten(F.transform(acc["level"], further)), 1, limit)
        return F.struct(F.slice(F.concat(acc["all"], level), 1, limit).alias("all"), level.alias("level"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(replaced)), state, grow, lambda acc: F.transform(acc["all"], lambda s: s["text"]))


# What a camera takes a sign for where the plate has a letter or a digit, the plate's pattern, and how many versions are tried and kept.
TO_DIGIT = {"O": "0", "I": "1", "B": "8", "S": "5", "Z": "2", "G": "6", "L": "4"}
TO_LETTER = {"0": "O", "1": "I", "8": "B", "5": "S", "2": "Z", "6": "G"}
CIVIL = r"^[A-Z]{2}[0-9]{2}[A-Z]{1,3}[0-9]{4}$"
TRIED, KEPT = 64, 16


def repaired(c: Column) -> Column:
    """A read's versions with signs of the wrong kind replaced: those that keep the plate's pattern first, then with fewest replaced, then by place.

    Of a read of 8 to 12 signs the first two and those before the last four are letters, the third, fourth and last four digits; other reads
    only have themselves. At most ``TRIED`` versions are looked at and ``KEPT`` are given; null and blank reads have none.
    """
    text = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")
    tables = [F.create_map(*(F.lit(x) for kv in t.items() for x in kv)) for t in (TO_LETTER, TO_DIGIT)]
    fits = lambda t: t.rlike(CIVIL)

    def swaps(t: Column) -> Column:
        """Places whose sign is of the wrong kind, and what it becomes."""
        n = F.length(t)
        sign = lambda i: F.substring(t, i, F.lit(1))
        new = lambda i: F.when((i <= 2) | (i > 4) & (i <= n - 4), F.try_element_at(tables[0], sign(i))).otherwise(F.try_element_at(tables[1], sign(i)))
        each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("i"), new(i).alias("o")))
        return F.when(n.between(8, 12), F.filter(each, lambda x: x["o"].isNotNull())).otherwise(F.filter(each, lambda x: F.lit(False)))

    def versions(t: Column, w: Column) -> Column:
        def further(s: Column) -> Column:
            return F.transform(F.filter(w, lambda x: x["i"] > s["last"]), lambda x: F.struct(F.concat(F.substring(s["text"], F.lit(1), x["i"] - 1), x["o"], F.substring(s["text"], x["i"] + 1, F.length(t))).alias("text"), x["i"].alias("last")))

        def grow(acc: Column, _: Column) -> Column:
            level = F.slice(F.flatten(F.transform(acc["level"], further)), 1, TRIED)
            return F.struct(F.slice(F.concat(acc["all"], level), 1, TRIED).alias("all"), level.alias("level"))

        first = F.array(F.struct(t.alias("text"), F.lit(0).alias("last")))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), F.struct(first.alias("all"), first.alias("level")), grow, lambda acc: F.transform(acc["all"], lambda s: s["text"]))

    # arrays of one element name what is computed once for each read
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    every = once(text, lambda t: once(swaps(t), lambda w: versions(t, w)))
    ordered = once(every, lambda v: F.concat(F.filter(v, fits), F.filter(v, lambda t: ~fits(t))))
    return F.filter(F.slice(ordered, 1, KEPT), lambda t: t != "")


def deletes(c: Column, k: int = 1) -> Column:
    """The text and all versions with up to k characters less: texts within k edits share one."""
    out = F.array(c)
    for _ in range(k):
        less = F.transform(out, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))
        out = F.array_distinct(F.concat(out, F.flatten(less)))
    return out


def by_deletes(reads: DataFrame, read: str, registry: DataFrame, key: str, k: int = 1) -> DataFrame:
    """(read, key) pairs that share a version with at most k characters less."""
    a = reads.select(norm_plate(F.col(read)).alias("read")).distinct().select("read", F.explode(deletes(F.col("read"), k)).alias("d"))
    b = registry.select(norm_plate(F.col(key)).alias("key")).distinct().select("key", F.explode(deletes(F.col("key"), k)).alias("d"))
    # versions are many times what the keys' table's size tells: no side is held whole by a task
    return a.hint("merge").join(b, "d").select("read", "key").distinct()


def recommended_overlap(reads: DataFrame, read: str, registry: DataFrame, key: str, edits: int = 2, q: int = 2) -> DataFrame:
    """(read, k): the least number of common q-grams that loses no key within ``edits`` edits: the smallest size of a key in the
    read's window of sizes, less q for each edit, 1 at least. Of sizes there is a handful; reads without q-grams have none."""
    sizes = tokens(registry, key, q).groupBy("key").agg(F.count("*").alias("n")).select("n").distinct()
    own = tokens(reads, read, q).groupBy(F.col("key").alias("read")).agg(F.count("*").alias("nx"))
    near = own.join(F.broadcast(sizes), F.abs(F.col("n") - F.col("nx")) <= q * edits, "left")
    return near.groupBy("read", "nx").agg(F.greatest(F.lit(1), F.coalesce(F.min("n"), F.first("nx")) - q * edits).alias("k")).select("read", "k")


def quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """recall (share of truth's (read, key) that are found) and mean candidates per read of truth."""
    n = truth.select("read").distinct().count()
    hit = truth.join(found.select("read", "key").withColumn("hit", F.lit(1)), ["read", "key"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall")).crossJoin(found.join(truth.select("read").distinct(), "read", "left_semi").agg((F.count("*") / F.lit(n)).alias("mean_candidates")))
