"""How sources of a language differ in their words, and by which words.

The sources' counts of a term are its column. Many terms have equal columns (a term that stands once in one source has that of
thousands of others), so columns are deduplicated: each pair of sources is evaluated once for each distinct column, and what it
gives is multiplied by the number of terms that have it. Terms are ranked by what was found of their column.

Columns are sparse. The pairs are cut into tiles of ``block`` by ``block`` sources; a column goes to a tile as the part of it that
the tile has, and parts that are equal are one again.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import folded, stored, term_counts

#: Texts that a term must stand in, ranks of terms that are returned, and sources of a tile's side.
LEAST, TOP, BLOCK = 3, 200, 64
SCALE = 1_000_000_000
_TERMS = folded(b"", string.ascii_letters.encode() + bytes(range(128, 256)))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact for totals up to 9 * 10**15: the quotient comes three digits at a time."""
    out, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def share_of(count: Column, total: Column) -> Column:
    """share() of Columns."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)")) + 1


def _pairs(block: int):
    """Sums over the distinct columns of some tiles, a row for each pair of a batch's tiles."""

    def run(batches):
        for b in batches:
            lang, i, j, column, times, own, other, v = (b.column(c) for c in ("lang", "i", "j", "counts", "times", "own", "other", "v"))
            keys: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(lang.to_pylist(), i.to_pylist(), j.to_pylist())):
                keys.setdefault(key, []).append(row)
            out: list[tuple] = []
            for (a, x, y), rows in keys.items():
                n, m, terms = (np.array(c[rows[0]].as_py(), np.int64) for c in (own, other, v))
                total = np.zeros((len(n), len(m)), np.int64)
                for k in range(0, len(rows), 1024):
                    some = column.take(pa.array(rows[k : k + 1024]))
                    at = np.repeat(np.arange(len(some)), np.diff(some.offsets.to_numpy()))
                    place, count = (some.flatten().field(c).to_numpy() for c in (0, 1))
                    weight = times.take(pa.array(rows[k : k + 1024])).to_numpy()[:, None]
                    p, q = (np.zeros((len(some), len(sizes)), np.int64) for sizes in (n, m))
                    for dense, tile in ((p, x), (q, y)):
                        mine = place // block == tile
                        dense[at[mine], place[mine] - tile * block] = count[mine]
                    p, q = share(p, n + terms), share(q, m + terms)
                    for s in range(len(n)):
                        away = p[:, s : s + 1] - q
                        total[s] += (weight * (away * away // q)).sum(0)
                out += [(a, x * block + s, y * block + t, int(total[s, t])) for s in range(len(n)) for t in range(len(m))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["lang", "place", "other", "value"])

    return run


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other one of its language, and by which terms.

    Terms are runs of letters of ASCII, of which A-Z are lower-cased, and of all other characters; a language keeps those of at
    least ``least`` of its texts. A count c among n of v kept terms gives p = 1 + floor(10**9 * (c + 1) / (n + v)). Between p and
    q lies f = floor((p - q)**2 / q). Part ``pair``: item is another source, value the sum of f over all kept terms. Part ``term``:
    item is a term that the source has, and more of than the language (whose share is q); the first ``top`` only. Ranks start at 1, by
    value descending, then item. All is exact: a language's sums stay below 4 * 10**18 for up to 10**9 kept terms.

    Nulls count as ''. Texts that are empty, or without a kept term, still make their group occur; if a language keeps no
    term all its pairs have 0. Repeated rows are texts of their own. No table, no rows. Other columns are not looked at.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    groups = rows.select("lang", "source").distinct()
    groups = stored(groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    counted = term_counts(rows, ["lang", "source"], _TERMS).join(groups, ["lang", "source"])
    columns = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "n"))).alias("counts"))
    columns = stored(columns.filter(F.col("docs") >= least).drop("docs"))
    sizes = columns.select("lang", F.inline("counts")).groupBy("lang", "place").agg(F.sum("n").alias("size"))
    langs = columns.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_size"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("size", "v", "lang_size")}
    groups = stored(groups.join(sizes, ["lang", "place"], "left").join(langs, "lang", "left").withColumns(zero))
    distinct = stored(columns.groupBy("lang", "counts").agg(F.count("*").alias("times"), F.first("n").alias("n")))

    side = groups.groupBy("lang", F.expr(f"place div {block}").cast("int").alias("i")).agg(F.array_sort(F.collect_list(F.struct("place", "size"))).alias("s"), F.first("v").alias("v"))
    own, other = side.select("lang", "i", F.col("s.size").alias("own"), "v"), side.select("lang", F.col("i").alias("j"), F.col("s.size").alias("other"))
    tiles = stored(own.join(other, "lang"))
    tile = lambda x: F.floor(x["place"] / block)
    inside = F.filter("counts", lambda x: (tile(x) == F.col("i")) | (tile(x) == F.col("j")))
    parts = distinct.join(tiles.select("lang", "i", "j"), "lang").groupBy("lang", "i", "j", inside.alias("counts")).agg(F.sum("times").alias("times"))
    sums = parts.join(tiles, ["lang", "i", "j"]).mapInArrow(_pairs(block), "lang string, place int, other int, value long")
    sums = sums.groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "place", "source")
    pairs = names.join(names.select("lang", F.col("place").alias("other"), F.col("source").alias("item")), "lang").filter("place <> other")
    pairs = pairs.join(sums, ["lang", "place", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    # of the terms of one column no more than the first can be ranked
    first = columns.withColumn("k", F.row_number().over(Window.partitionBy("lang", "counts").orderBy("term"))).filter(F.col("k") <= top)
    found = distinct.select("lang", "counts", F.col("n").alias("all"), F.inline("counts")).join(groups, ["lang", "place"])
    p, q = share_of(F.col("n"), F.col("size") + F.col("v")), share_of(F.col("all"), F.col("lang_size") + F.col("v"))
    found = found.select("lang", "counts", "source", p.alias("p"), q.alias("q")).filter("p > q")
    value = F.expr("(p - q) * (p - q) div q")
    terms = found.withColumn("value", value).join(first.select("lang", "counts", "term"), ["lang", "counts"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top))
