"""License scans with DataFrame functions alone: MinHash bands over overlapping text windows, then exact containment.

Words are the letter and digit runs of the lower-cased text, shingles five words. The windows of a text
are seven words long and start every three words, so that each shingle lies in one window (three
shingles). A band is one MinHash value of a window. A template's windows start at each of its words; one
of three or more shingles that stands in a document unchanged therefore fills one of the document's
windows, and all bands agree. In the worst case, a template of a single shingle, a band agrees with
probability 1/3, and one of 16 with 1 - (2/3)**16 > 0.998. Found templates are verified exactly: the share
of a template's shingles that the document holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import TEMPLATES

SHINGLE = 5
SPAN = 3
BANDS = 16
CONTAINMENT = 0.8
#: Share of a template's windows that are indexed. A changed word takes five shingles and spoils the nine windows that a document's
#: window could be aligned to; a fifth of the shingles may be missing, so 0.36 of the windows at most are spoilt.
FRONT = 0.36
#: Band values of templates that one pass over the documents looks for.
BLOCK = 8_000
#: The table that band values are looked up in has 2**SLOTS bytes.
SLOTS = 17

def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, n: int = SHINGLE) -> Column:
    """Hashes of all runs of n words, in order."""
    run = lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(n)))
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), run)).otherwise(F.array().cast("array<bigint>"))


def bands(s: Column, step: int, span: int = SPAN, k: int = BANDS, exact: bool = False) -> Column:
    """Band values of the windows of span shingles that start at every step-th shingle.

    A last window may be shorter. Templates leave out what it lacks (exact); in documents all of that counts as one more
    shingle, which costs less to compute and leaves a shingle of the window at least the same chance.
    """
    hashed = lambda i, b: F.xxhash64(F.get(s, i), F.lit(b))
    value = lambda i, b: F.least(*((F.when(F.get(s, i + j).isNotNull(), hashed(i + j, b)) if exact else hashed(i + j, b)) for j in range(span)))
    window = lambda i: F.array(*(value(i, b) for b in range(k)))
    return F.when(F.size(s) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(step)), window))).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates=None) -> DataFrame:
    """(license, t_shingles, t_bands) of the templates; those of fewer than SHINGLE words can't be found."""
    rows = spark.createDataFrame([*(TEMPLATES if templates is None else templates).items()], "license string, body string")
    t = rows.select("license", F.array_distinct(shingles(words(F.col("body")))).alias("t_shingles")).filter(F.size("t_shingles") > 0)
    front = F.slice("t_shingles", F.lit(1), F.ceil(F.size("t_shingles") * FRONT).cast("int") + SPAN + 2)
    return t.select("license", "t_shingles", F.array_distinct(bands(front, 1, exact=True)).alias("t_bands"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of docs and template that it holds: id, license, containment, n_found, n_shingles.

    Null, empty and short texts hold nothing; equal rows each get their own; other columns aren't read; no rows or no
    templates, no result. The template list is a parameter of the call. A table of its bands (128 KB) goes into the plan, in blocks of
    at most BLOCK of them, each a pass over docs: documents are never shuffled, and only those that may share a band go on, to an
    equality join on bands. A document that shares several bands with a template goes on by the smallest of them.
    """
    blocks: list[list] = [[]]
    for r in sorted(template_table(docs.sparkSession, templates).collect()):
        if blocks[-1] and sum(len(x["t_bands"]) for x in blocks[-1]) + len(r["t_bands"]) > BLOCK:
            blocks.append([])
        blocks[-1].append(r)
    s = docs.select(F.col(f"`{id_col}`").alias("id"), words(F.col(f"`{text_col}`")).alias("w")).select("id", shingles(F.col("w")).alias("s"))
    return reduce(DataFrame.unionByName, (_found(s, b, id_col, containment) for b in blocks))


def _maybe(known: list[int]):
    """A test of band values that no known one fails, and few others pass: three bytes of a table of 2**SLOTS, a literal of the plan, must be 1."""
    table, mask, shifts = bytearray(1 << SLOTS), (1 << SLOTS) - 1, (0, 21, 42)
    for x in known:
        for k in shifts:
            table[(x & (1 << 64) - 1) >> k & mask] = 1
    one, of = F.lit(bytearray(b"\x01")), F.lit(table)
    at = lambda x, k: F.shiftrightunsigned(x, k).bitwiseAND(F.lit(mask)).cast("int") + 1
    return lambda x: (F.substring(of, at(x, 0), 1) == one) & (F.substring(of, at(x, 21), 1) == one) & (F.substring(of, at(x, 42), 1) == one)


def _found(s: DataFrame, templates: list, id_col: str, containment: float) -> DataFrame:
    t = s.sparkSession.createDataFrame(templates, "license string, t_shingles array<bigint>, t_bands array<bigint>")
    known = sorted({x for r in templates for x in r["t_bands"]})
    # a filter on the bands would be pushed below their projection and compute them again; a null from explode_outer isn't
    found = F.filter(F.array(F.array_distinct(F.filter(bands(F.col("s"), SPAN), _maybe(known)))), lambda x: F.size(x) > 0)
    near = s.select("id", "s", F.explode_outer(found).alias("found")).filter(F.col("found").isNotNull())
    near = near.select("id", "found", F.array_distinct("s").alias("s"), F.explode("found").alias("band"))
    # both are of at most BLOCK bands, so they are broadcast
    pairs = near.join(F.broadcast(t.select("license", F.explode("t_bands").alias("band"))), "band").join(F.broadcast(t), "license")
    pairs = pairs.filter(F.col("band") == F.array_min(F.array_intersect("found", "t_bands")))
    pairs = pairs.select("id", "license", F.size(F.array_intersect("s", "t_shingles")).cast("long").alias("n_found"), F.size("t_shingles").cast("long").alias("n_shingles"))
    share = F.col("n_found") / F.col("n_shingles")
    return pairs.select(F.col("id").alias(id_col), "license", share.alias("containment"), "n_found", "n_shingles").filter(F.col("containment") >= containment)
