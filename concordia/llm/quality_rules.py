"""Quality rules: counts of a text, and bands that its compression ratios must lie in.

A text that compresses too well repeats itself or its signs; one that hardly compresses is noise. Short texts
compress less whatever they say, so the limits depend on length, between knots in proportion to its logarithm. They are
fitted to labelled good texts: a curve through their ratios, and around it, in bands of equally many texts, how far all but the
outermost half a hundredth of them stray. Each fixed chunk is held to the limits of its own length too: a long document may hide a
repetitive stretch that its total ratio does not show, so a share of bad chunks rejects it.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept
from .importance import labelled

#: Knots (bytes, lowest ratio, highest ratio) where nothing is fitted, ratio = compressed / raw bytes: only extremes are out.
BANDS = ((1, 0.0, 20.0), (200, 0.18, 1.02), (1_000, 0.15, 0.85), (4_000, 0.12, 0.75), (16_000, 0.10, 0.70), (65_536, 0.08, 0.66))
#: Share of labelled good texts that a fitted limit may leave out, texts in a band, and what limits widen by for each doubling of the length beyond what was seen.
OUTSIDE, IN_BAND, WIDEN = 0.005, 200, 0.02
CHUNK_BYTES = 4_096
BAD_CHUNKS = 0.5
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
#: Deletes all bytes but the symbols, which are ASCII and so never part of a longer character.
_OTHERS = bytes(b for b in range(256) if b not in SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(windows) == len(set(windows)):
        return 0
    count, covered, reach = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + 3 - max(i, reach)
            reach = i + 3
    return covered


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def in_band(n_bytes: int, ratio: float, bands=BANDS) -> bool:
    """Whether the ratio lies within the limits at this length; beyond the first and last knot they are wider by the octave."""
    x = math.log2(max(n_bytes, 1))
    at = [math.log2(b[0]) for b in bands]
    beyond = WIDEN * max(at[0] - x, x - at[-1], 0)
    return float(np.interp(x, at, [b[1] for b in bands])) - beyond <= ratio <= float(np.interp(x, at, [b[2] for b in bands])) + beyond


def fitted(seen: DataFrame, outside: float = OUTSIDE, in_band: int = IN_BAND):
    """Knots of the limits that all but a share of the given good texts (n, ratio) keep; BANDS if there are fewer than ``in_band``.

    The curve comes from sums, the bands' edges from the counts of each length, and a band's limits from ranks within it: rows never come to the driver.
    """
    x = F.log2(F.greatest("n", F.lit(1)))
    rows, low, high, lengths = seen.agg(F.count("*"), F.min(x), F.max(x), F.count_distinct("n")).first()
    if rows < in_band:
        return BANDS
    bands, degree = max(1, min(32, rows // in_band)), min(3, lengths - 1)
    at = lambda v: (2 * v - (low + high)) / (high - low) if high > low else v * 0.0
    part = [i / bands for i in range(1, bands)]
    sums = seen.select("n", "ratio", at(x).alias("u")).agg(*(F.sum(F.pow("u", F.lit(k))) for k in range(2 * degree + 1)), *(F.sum(F.pow("u", F.lit(k)) * F.col("ratio")) for k in range(degree + 1)), F.percentile("n", F.array(*map(F.lit, part))) if part else F.lit(None)).first()
    powers, right, edges = sums[: 2 * degree + 1], sums[2 * degree + 1 : -1], sums[-1] or []
    factors = np.linalg.lstsq(np.array([[powers[i + j] for j in range(degree + 1)] for i in range(degree + 1)]), np.array(right), rcond=None)[0].tolist()
    curve = lambda v: sum((c * at(v) ** k for k, c in enumerate(factors[1:], 1)), v * 0.0 + factors[0])
    band = sum((F.when(F.col("n") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    placed = seen.select(band.alias("band"), x.alias("x"), (F.col("ratio") - curve(x)).alias("off"))
    w = Window.partitionBy("band")
    ranked = placed.withColumns({"r": F.row_number().over(w.orderBy("off")) - 1, "m": F.count("*").over(w) - 1})
    limit = lambda place: F.max(F.when(F.col("r") == place, F.col("off")))
    found = ranked.groupBy("band").agg(F.median("x").alias("x"), limit(F.floor(outside * F.col("m"))).alias("low"), limit(F.ceil((1 - outside) * F.col("m"))).alias("high")).orderBy("band").collect()
    knots = [(2 ** r["x"], curve(r["x"]) + r["low"], curve(r["x"]) + r["high"]) for r in found]
    ends = [(2**v, curve(v) + r["low"], curve(v) + r["high"]) for v, r in ((low, found[0]), (high, found[-1]))]
    return tuple(sorted({k[0]: k for k in (ends[0], *knots, ends[1])}.values()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", level: int = LEVEL):
    """Limits fitted to all rows that are labelled good and pass the base rules.

    Null ids and labels are passed over; without enough good rows the limits are BANDS.
    """
    chosen = labelled(labels, id_col, label_col).filter("good = 1")

    def measure(batches):
        press = zstandard.ZstdCompressor(level=level).compress
        for b in batches:
            length, ratio = [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                words = (t or b"").split()
                passes = len(words) >= 50 and 100 * repeat_words(words) <= 50 * len(words)
                length.append(len(t) if passes else None)
                ratio.append(len(press(t)) / len(t) if passes else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(length, pa.int64()), pa.array(ratio, pa.float64())], names=["_id", "n", "ratio"])

    # all texts are measured where they are, and only numbers meet the labels: no text is shuffled
    kind = docs.schema[id_col].dataType.simpleString()
    measured = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(measure, f"_id {kind}, n long, ratio double").filter("n is not null")
    return fitted(kept(measured.join(chosen, "_id").select("n", "ratio")))


def judge(text: bytes, press, bands=BANDS, chunk: int = CHUNK_BYTES, bad_chunks: float = BAD_CHUNKS) -> tuple:
    words = text.split()
    n, repeats = len(words), repeat_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    ratio = len(press(text)) / len(text) if text else 0.0
    parts = [text[i : i + chunk] for i in range(0, len(text), chunk)] if len(text) > chunk else []
    bad = sum(not in_band(len(p), len(press(p)) / len(p), bands) for p in parts) / len(parts) if parts else 0.0
    kept = not failed and in_band(len(text), ratio, bands) and bad <= bad_chunks
    joined = b"".join(words)
    return (n, len(joined.translate(None, _CONTINUATION)), len(text.translate(None, _OTHERS)), dup_lines(text), repeats, failed, kept, ratio, bad)


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk: int = CHUNK_BYTES, bad_chunks: float = BAD_CHUNKS, level: int = LEVEL) -> DataFrame:
    """One row per row of docs, id and SCHEMA; ``ratio`` is of the whole text, ``bad_chunks`` a share.

    Null and empty texts count as no words: all counts 0, base_failed true, kept false. Rows are judged
    alone, so ties, repeated rows and long texts need nothing special; other columns are not read.
    """
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches):
        press = zstandard.ZstdCompressor(level=level).compress
        for b in batches:
            rows = [judge(t or b"", press, bands, chunk, bad_chunks) for t in b.column(1).cast(pa.binary()).to_pylist()]
            cols = list(zip(*rows)) or [()] * len(names)
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=[b.schema.names[0], *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
