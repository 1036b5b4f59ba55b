"""Document fingerprints from closed syncmers, with DataFrame functions alone.

Units are words. A k-mer (five words) is a closed syncmer if the smallest hash among its inner two-word
runs is that of its first or its last one: this depends on the k-mer alone, not on what stands around
it, so an edit moves no anchor that it doesn't touch. A fingerprint lists anchors with the place of their first word. Of a
text with more than ANCHORS syncmers those stay whose hash is a multiple of the power of two that leaves about that many: they
lie over the whole text, and what stays of one text stays of its copies. Fingerprints are matched by position: shared
anchors have a displacement, and those count that keep near the median one. The likeness is their share of all anchors of
both, at the coarser one's power of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

K = 5
S = 2
#: Anchors up to which a text keeps all of them, and how far displacements may lie apart: words, and as a share of the longer text's last place.
ANCHORS = 64
DRIFT, DRIFT_SHARE = 16, 0.02


def word_hashes(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def syncmers(w: Column, inner: Column, k: int = K) -> tuple[Column, Column]:
    """(h, p) of the closed syncmers, a hash of 32 bits and the place, and what stands for a text that has none: all of it, unless it is blank.

    w: word hashes, inner: of each two words.
    """
    n = k - S + 1
    one = lambda h, p: F.struct(h.alias("h"), p.cast("int").alias("p"))

    def kmer(i):
        edge, middle = F.least(F.get(inner, i), F.get(inner, i + n - 1)), F.least(*(F.get(inner, i + j) for j in range(1, n - 1)))
        return F.when(edge <= middle, one(F.hash(F.get(inner, i), F.get(inner, i + 2), F.get(inner, i + n - 1)), i))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - k), kmer), lambda h: h.isNotNull())
    return F.when(F.size(w) >= k, found).otherwise(F.array().cast("array<struct<h:int,p:int>>")), F.when(F.size(w) > 0, F.array(one(F.hash(w), F.lit(0))))


def _mask(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), bits) - 1


def coarser(anchors: Column, bits: Column) -> Column:
    """The anchors whose hashes end in so many zero bits."""
    return F.filter(anchors, lambda a: a["h"].bitwiseAND(_mask(bits)) == 0)


def with_fingerprint(df: DataFrame, text: Column, name: str, size: int = ANCHORS) -> DataFrame:
    """df with the fingerprint of a text, (bits, anchors): each step a projection of its own, so nothing is computed twice. Of equal anchors the first stays."""
    w, inner, every, hs = f"{name}_w", f"{name}_s", f"{name}_a", f"{name}_h"
    out = df.withColumn(w, word_hashes(text))
    out = out.withColumn(inner, F.zip_with(w, F.slice(w, 2, F.size(w) + 1), lambda a, b: F.xxhash64(a, b)))
    found, whole = syncmers(F.col(w), F.col(inner))
    out = out.withColumn(every, found).withColumn(every, F.when(F.size(every) == 0, F.coalesce(whole, F.col(every))).otherwise(F.col(every))).drop(inner)
    out = out.withColumn(hs, F.transform(F.col(every), lambda a: a["h"])).withColumn(w, F.array_distinct(hs))
    bits = F.coalesce(F.greatest(F.lit(0), F.ceil(F.log2(F.size(w) / F.lit(float(size))))), F.lit(0)).cast("int")
    out = out.withColumn(inner, bits).withColumn(w, F.filter(F.col(w), lambda h: h.bitwiseAND(_mask(F.col(inner))) == 0))
    first = F.transform(F.col(w), lambda h: F.element_at(F.col(every), F.array_position(F.col(hs), h).cast("int")))
    return out.withColumn(name, F.struct(F.col(inner).alias("bits"), first.alias("anchors"))).drop(w, inner, every, hs)


def as_text(sketch: Column) -> Column:
    """Anchors in order, eight hex digits of the hash and, after a colon, the place; the power of two before all, unless it is 0."""
    anchors = F.array_join(F.transform(sketch["anchors"], lambda a: F.concat(F.lpad(F.lower(F.hex(a["h"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"), F.lit(":"), a["p"].cast("string"))), " ")
    return F.when(sketch["bits"] > 0, F.concat(F.lit("/"), sketch["bits"].cast("string"), F.lit(" "), anchors)).otherwise(anchors)


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the likeness, 0 to 1, of two fingerprints; of two empty ones 1."""
    x, y, moved = f"{name}_x", f"{name}_y", f"{name}_d"
    bits = F.greatest(F.col(a)["bits"], F.col(b)["bits"])
    out = df.withColumns({x: coarser(F.col(a)["anchors"], bits), y: coarser(F.col(b)["anchors"], bits)})
    hs = F.transform(F.col(y), lambda z: z["h"])
    at = F.transform(F.col(x), lambda z: F.struct(F.array_position(hs, z["h"]).cast("int").alias("at"), z["p"].alias("p")))
    out = out.withColumn(moved, F.array_sort(F.transform(F.filter(at, lambda z: z["at"] > 0), lambda z: F.get(F.col(y), z["at"] - 1)["p"] - z["p"])))
    middle = F.get(F.col(moved), F.floor((F.size(moved) - 1) / 2).cast("int"))
    last = lambda c: F.coalesce(F.get(F.col(c), F.size(c) - 1)["p"], F.lit(0))
    drift = F.greatest(F.lit(float(DRIFT)), F.lit(DRIFT_SHARE) * F.greatest(last(x), last(y)))
    out = out.withColumn(moved, F.size(F.filter(F.col(moved), lambda d: F.abs(d - middle) <= drift)))
    both = F.size(x) + F.size(y)
    share = F.when((F.size(F.col(a)["anchors"]) == 0) & (F.size(F.col(b)["anchors"]) == 0), 1.0).when(both == 0, 0.0).otherwise(F.col(moved) / (both - F.col(moved)))
    return out.withColumn(name, share).drop(x, y, moved)


def with_next(df: DataFrame, id_col: str, columns: list[str], tie: list[str]) -> DataFrame:
    """df with next_<column>, from the row that follows in ascending order of id_col (then tie); the last one's next is the first.

    Rows are cut into ranges of ids. A row that begins a range is also put, as a guest, at the end of the range
    before, so each range can be read alone. Ids that are null stand last. Only the range bounds, one id per
    partition, come to the driver.
    """
    n = partitions(df, 2)
    found = df.agg(F.percentile_approx(id_col, [i / n for i in range(n)], 10_000), F.min(id_col)).first()
    starts = sorted({*(found[0] or []), *([] if found[1] is None else [found[1]])})
    last = max(0, len(starts) - 1)
    bounds = F.array(*map(F.lit, starts)) if starts else F.array().cast("array<bigint>")
    place = F.when(F.col(id_col).isNull(), last).otherwise(F.greatest(F.lit(0), F.size(F.filter(bounds, lambda b: b <= F.col(id_col))) - 1))
    begins = F.array_position(bounds, F.col(id_col)).cast("int")
    first = F.col(id_col).isNull() if not starts else F.coalesce(begins, F.lit(0)) > 0
    before = F.lit(last) if not starts else F.when(begins > 1, begins - 2).otherwise(last)
    homes = F.when(first, F.array(F.struct(place.alias("range"), F.lit(False).alias("guest")), F.struct(before.cast("int").alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(place.alias("range"), F.lit(False).alias("guest"))))
    out = df.select("*", F.inline(homes))
    w = Window.partitionBy("range").orderBy("guest", F.col(id_col).asc_nulls_last(), *tie)
    out = out.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns), F.lead("guest").over(w).alias("_after"))
    # the table's only range or its last one may hold no guest, if all ids are null
    return out.filter(~F.col("guest")).drop("range", "guest", "_after")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text edited: its last quarter replaced by the beginning of the next one's.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (0 to 1).
    Null texts count as empty; an empty text's fingerprint is empty, and two empty ones are alike. Rows of equal ids
    follow each other by text. Texts go whole through one shuffle, by ranges of ids.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    base = with_fingerprint(base, F.col("text"), "sketch")
    out = with_next(base, "id", ["text", "sketch"], ["text"])
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("next_text", "text"), F.lit(1), cut))
    out = out.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", F.coalesce("next_sketch", "sketch").alias("next_sketch"))
    out = with_fingerprint(out, F.col("edited"), "edited_sketch")
    out = with_likeness(with_likeness(out, "sketch", "edited_sketch", "near_edited"), "sketch", "next_sketch", "near_next")
    return out.select(F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")
