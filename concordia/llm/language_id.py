"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams (one to three characters of words
padded with a blank). A document's most frequent n-grams are compared with each profile: an n-gram
costs the difference of its two ranks, or the longest profile where it's missing. The language
with the smallest sum wins.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, texts

#: n-grams in a profile, and of a document that are looked up.
PROFILE = 400
#: Languages whose profiles are compared in one pass; more go through in blocks, so what tasks get stays bounded.
BLOCK = 256
UNKNOWN = "und"
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letter


def gram_codes(text: str) -> np.ndarray:
    """The text's n-grams of one to three characters, each as one number; every run of other characters is one blank.

    No n-gram has a blank inside, so each belongs to one word; a blank alone isn't counted.
    """
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(_letters()[c], c, 0)
    c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != 0]
    return np.concatenate([c[c != 0], two[two != 0] | 1 << 62, three])


def top(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n codes of the highest counts, ties by code."""
    if len(codes) > 4 * n:
        least = np.partition(counts, -n)[-n]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:n]]


def profiles(train: DataFrame, text_col: str, lang_col: str, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of every language of train, rank from 0. Counts are over all its texts.

    Each batch is counted before anything is shuffled, so a language that most rows have costs a task no more.
    """

    def count(batches):
        for b in batches:
            langs = b.column(1).to_pylist()
            parts: dict[str, list[np.ndarray]] = {}
            _, offsets = texts(b.column(0))
            for i, j in chunks(offsets):
                own = b.column(0).slice(i, j - i).to_pylist()
                for t, lang in zip(own, langs[i:j]):
                    parts.setdefault(lang, []).append(gram_codes(t or ""))
                for lang in [*parts] if j == len(langs) else [x for x in parts if sum(map(len, parts[x])) > 1 << 22]:
                    codes, n = np.unique(np.concatenate(parts.pop(lang)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counted = train.select(text_col, lang_col).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the highest counts of each (language, slice), then of each language: no task sees all n-grams of a language
    from pyspark.sql import Window

    for keys in (["lang", F.pmod(F.hash("gram"), F.lit(64))], ["lang"]):
        w = Window.partitionBy(*keys).orderBy(F.desc("n"), "gram")
        counted = counted.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < size)
    return counted.select("lang", "gram", "rank")


def identify(docs: DataFrame, learned: DataFrame, id_cols: list[str], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """id_cols, lang_pred and score (0 to 1) of every row of docs.

    A text that is null or has no letter is ``und`` with score 0, as is every text where no language was learned.
    Equal distances go to the language that sorts first. Whole texts are read; repeated rows get equal answers.
    score is 1 less the distance as a share of the largest possible one.
    """
    langs = sorted(r[0] for r in learned.select("lang").distinct().toLocalIterator())
    out = docs.select(*id_cols, F.col(text_col).alias("_text"), F.lit(None).cast("string").alias("_lang"), F.lit(None).cast("double").alias("_cost"))
    for k in range(0, len(langs), BLOCK):
        block = langs[k : k + BLOCK]
        rows = learned.filter(F.col("lang").isin(block)).collect()  # at most BLOCK * PROFILE rows
        grams = np.array(sorted({r["gram"] for r in rows}), np.int64)
        ranks = np.full((len(grams), len(block)), -1, np.int32)
        place = {x: i for i, x in enumerate(block)}
        for r in rows:
            ranks[np.searchsorted(grams, r["gram"]), place[r["lang"]]] = r["rank"]

        def nearest(batches, block=block, grams=grams, ranks=ranks):
            for b in batches:
                text, lang, cost = (b.column(b.schema.names.index(c)).to_pylist() for c in ("_text", "_lang", "_cost"))
                for i, t in enumerate(text):
                    codes, n = np.unique(gram_codes(t or ""), return_counts=True)
                    if not len(codes):
                        continue
                    mine = top(codes, n, size)
                    at = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
                    theirs = np.where((grams[at] == mine)[:, None], ranks[at], -1)
                    away = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(mine))[:, None])).sum(0)
                    best = int(np.argmin(away))
                    share = float(away[best]) / (size * len(mine))
                    if cost[i] is None or share < cost[i]:
                        lang[i], cost[i] = block[best], share
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(lang, pa.string()), pa.array(cost, pa.float64())], names=b.schema.names)

        out = out.mapInArrow(nearest, out.schema)
    return out.select(*id_cols, F.coalesce("_lang", F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col("_lang").isNull(), 0.0).otherwise(1 - F.col("_cost")).alias("score"))
