"""Phrases whose words keep together, from suffix automata of shards.

A frequent phrase is made of frequent pairs of words. So
1. words are counted by language, exactly;
2. pairs of words are counted by 64-bit hashes. That is a filter: a phrase of rare pairs is rare. What clashes only makes the filter
   coarser, as does the bounded map of bits that tasks get of it;
3. each task cuts texts where a pair is rare, and reads what is left into one automaton for each language and shard. A state's strings
   end at the same places, so the states give each different substring of bounded depth once, with its number of occurrences.
   The counts of all shards are summed: those of every phrase that is frequent in all are exact;
4. a phrase without its first word is its suffix link, without its last its stem. The counts of longer phrases go down
   both kinds of links, a word at a time, to all phrases that they contain, of which they subsume some.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automaton import CountingAutomaton
from .common import CHUNK, bitmap, chunks, folded, marked, mix, stored, term_counts, texts, word_hashes, words

LEAST, DEPTH, TOP = 30, 4, 2000
#: A longer phrase subsumes one that has at most 100 / 80 of its occurrences.
SUBSUMED = 80
SCALE = 2_000_000
#: Words that one automaton reads (some 450 bytes each), and keys that a task gathers before it counts them.
SHARD, GATHERED = 100_000, 1 << 20
UNKNOWN = "und"

_U = np.uint64
_ENDS = b".,;:!?\n\x0b\x0c\r"
_BLANK = folded(_ENDS)
_PIECES = bytes(10 if i in _ENDS else 32 if i == 9 else x for i, x in enumerate(folded(b"")))


def _keys(langs: list, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word and its text's language."""
    own = {x: _U(int.from_bytes(x.encode()[-7:], "little") * 31 + len(x)) for x in set(langs)}
    lang = np.repeat(np.array([own[x] for x in langs], _U), np.diff(first))
    return mix(word_hashes(data, starts, ends) ^ mix(lang + _U(1)))


def _read(column: pa.Array, langs: list):
    """(languages by word, folded bytes, starts, ends, key of each word, key of the pair that begins at each word but the last, whether it's within a piece) of some texts after others."""
    data, offsets = texts(column)
    for i, j in chunks(offsets):
        part = np.frombuffer(data[offsets[i] : offsets[j]].tobytes().translate(_PIECES), np.uint8)
        starts, ends, first = words(part, offsets[i : j + 1] - offsets[i])
        if not len(starts):
            continue
        key = _keys(langs[i:j], part, starts, ends, first)
        broken = np.cumsum(part == 10, dtype=np.int32)
        joined = broken[ends[:-1] - 1] == broken[starts[1:]]
        joined[first[(first > 0) & (first < len(starts))] - 1] = False
        yield np.repeat(np.arange(i, j), np.diff(first)), part, starts, ends, key, mix(key[:-1] * _U(3) + mix(key[1:])), joined


def frequent(rows: DataFrame, least: int, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n) of all words, (lang, phrase, n) of the words, and of the phrases of two to ``depth`` words, that occur ``least`` times. rows: lang, text, never null."""
    counted = stored(term_counts(rows, ["lang"], _BLANK).select("lang", F.col("term").alias("phrase"), "n"))
    single = counted.filter(F.col("n") >= least)
    context = rows.sparkSession.sparkContext

    def named(batches):
        for b in batches:
            data, offsets = texts(b.column(1))
            key = _keys(b.column(0).to_pylist(), data, offsets[:-1], offsets[1:], np.arange(len(offsets)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    one = context.broadcast(bitmap(single.select("lang", "phrase").mapInArrow(named, "key long"), "key"))

    def pairs(batches):
        gathered, n = [], 0
        for b in batches:
            for *_, key, pair, joined in _read(b.column(1), b.column(0).to_pylist()):
                known = marked(one.value, key)
                gathered.append(pair[joined & known[:-1] & known[1:]])
                n += len(gathered[-1])
                if n > GATHERED:
                    yield counts(gathered)
                    gathered, n = [], 0
        if n:
            yield counts(gathered)

    def counts(gathered):
        key, n = np.unique(np.concatenate(gathered), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    paired = rows.select("lang", "text").mapInArrow(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    two = context.broadcast(bitmap(stored(paired.select("key")), "key"))

    def enumerated(batches):
        shard: dict[str, CountingAutomaton] = {}
        size = 0
        for b in batches:
            langs = b.column(0).to_pylist()
            for row, part, starts, ends, _, pair, joined in _read(b.column(1), langs):
                linked = np.append(joined & marked(two.value, pair), False)
                begin = np.flatnonzero(linked & ~np.append(False, linked[:-1]))
                stop = np.flatnonzero(~linked & np.append(False, linked[:-1])) + 1
                raw, starts, ends = part.tobytes(), starts.tolist(), ends.tolist()
                for i, j, r in zip(begin.tolist(), stop.tolist(), row[begin].tolist()):
                    automaton = shard.get(langs[r]) or shard.setdefault(langs[r], CountingAutomaton())
                    automaton.add([raw[x:y] for x, y in zip(starts[i:j], ends[i:j])])
                    size += j - i
                    if size > SHARD:
                        yield from handed(shard)
                        shard, size = {}, 0
        yield from handed(shard)

    def handed(shard):
        for lang, a in shard.items():
            rows = [(b" ".join(a.words[i:j]), n) for i, j, n in a.substrings(2, depth)]
            phrase, n = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

    found = rows.select("lang", "text").mapInArrow(enumerated, "lang string, phrase string, n long").groupBy("lang", "phrase")
    phrases = stored(found.agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    return counted.groupBy("lang").agg(F.sum("n").alias("n")), single, phrases


def _exact(x):
    return x.cast("decimal(20,0)")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` phrases of each language, by score, count, then phrase.

    Texts, A-Z lower-cased, are split into pieces at . , ; : ! ? and line ends, and those into words at blanks and tabs. A phrase
    has two to ``depth`` words of a piece and occurs a >= ``least`` times, overlaps included. Cut after its first words it has parts that
    occur l and r times; score is floor(2,000,000 * a / (l + r)) at the cut that makes it lowest, the first of equal ones. Phrases are
    left out whose words stand together in a longer one that occurs at least 0.8 times as often. n: all words of the language.

    A null language is ``und``; null and empty texts have no words; repeated rows are texts of their own. A table without a
    frequent phrase gives no rows. Other columns are not looked at.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    totals, single, phrases = frequent(rows, least, depth)
    split = phrases.withColumn("w", F.split("phrase", " ", -1)).withColumn("m", F.size("w"))
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")

    # the largest count of a longer phrase goes down links and stems, a word at a time
    links = stored(split.filter("m > 2").select("lang", "m", "phrase", "n", F.explode(F.array_distinct(F.array(joined(F.lit(2), F.col("m") - 1), joined(F.lit(1), F.col("m") - 1)))).alias("inner")))
    over = None
    for m in range(depth, 2, -1):
        level = links.filter(F.col("m") == m)
        most = F.col("n")
        if over is not None:
            level, most = level.join(over.select("lang", "phrase", "over"), ["lang", "phrase"], "left"), F.greatest("n", "over")
        level = level.groupBy("lang", F.col("inner").alias("phrase")).agg(F.max(most).alias("over"))
        over = level.withColumn("m", F.lit(m - 1)) if over is None else over.unionByName(level.withColumn("m", F.lit(m - 1)))
    kept = split
    if over is not None:
        subsumed = phrases.join(over, ["lang", "phrase"]).filter(100 * _exact(F.col("over")) >= SUBSUMED * _exact(F.col("n"))).select("lang", "phrase")
        kept = split.join(subsumed, ["lang", "phrase"], "left_anti")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    parts = single.unionByName(phrases)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * _exact(F.col("a")), _exact(F.col("l")) + _exact(F.col("r")))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # the first of each slice of a language, then of the language: no task sees all its phrases
    order = (F.desc("score"), F.desc("a"), "phrase")
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(64))], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return scored.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
