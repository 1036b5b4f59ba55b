import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.llm import passages
from concordia.llm.automaton import SuffixAutomaton
from concordia.llm.bwt import intervals, merged, repeated, shards
from concordia.llm.common import stored

from . import brute


def _rows(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def check(spark, rows, schema=brute.SCHEMA, **sizes):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    pairs = [(r[0], r[1]) for r in rows]
    got = passages.repeated_bytes(docs, **sizes).select("row.doc_id", "n_units", "n_removed", "n_spans", "kept_sha256")
    assert _rows(got, got.columns) == sorted(brute.repeated_bytes(pairs), key=repr)
    got = passages.repeated_words(docs, **sizes).select("row.doc_id", "n_units", "n_removed", "kept_sha256")
    assert _rows(got, got.columns) == sorted(brute.repeated_words(pairs), key=repr)


def test_against_all_windows(spark):
    check(spark, brute.documents())


def test_crowded_anchors_are_dealt_out_finer(spark):
    check(spark, brute.documents(2), together=1)


def test_small_blocks(spark):
    check(spark, brute.documents(3), block=1)


def test_empty_table(spark):
    check(spark, [])


def test_synthetic_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, "doc_id long, text string")


def _common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))


@pytest.mark.parametrize("limit", [1, 8, 1000])
def test_merge_equals_sorting(limit):
    strings = [s.encode() for s in ("banana", "ananas", "bananarama", "", "na" * 20, "nab", "banana")]
    for depth in (1, 2, 3, 11, 12, 200):
        parts = shards(strings, limit)
        position, common = merged(parts, depth)
        prefixes = [(p.tobytes()[i:] + p.tobytes() * depth)[:depth] for p in parts for i in range(len(p))]
        ordered = [prefixes[i] for i in position.tolist()]
        assert ordered == sorted(prefixes) and sorted(position) == list(range(len(prefixes)))
        assert common.tolist() == [0, *map(_common, ordered, ordered[1:])]
        twice = [sum(q == p for q in prefixes) > 1 for p in ordered]
        assert intervals(common, depth).tolist() == twice


def test_nothing_is_removed_beside_the_method(spark, monkeypatch):
    """With a search that finds nothing, no byte and no word goes: no plainer path stands beside it."""
    docs = spark.createDataFrame(brute.documents(4), brute.SCHEMA)
    monkeypatch.setattr(passages, "_by_bwt", lambda rows, length: iter(()))
    monkeypatch.setattr(passages, "_by_automaton", lambda rows, length: iter(()))
    for together in (1, 1000):
        for f in (passages.repeated_bytes, passages.repeated_words):
            assert f(docs, together=together).agg({"n_removed": "sum"}).first()[0] == 0


def test_automaton_against_all_windows():
    r = random.Random(5)
    lists = [([r.choice("abc") for _ in range(r.randint(0, 40))], rank) for rank in range(8)]
    automaton = SuffixAutomaton(lists)
    for n in (1, 3, 7):
        for words in [w for w, _ in lists] + [[r.choice("abcd") for _ in range(60)]]:
            want = [(i, min(ranks)) for i in range(len(words) - n + 1) if (ranks := [k for w, k in lists for j in range(len(w) - n + 1) if w[j : j + n] == words[i : i + n]])]
            assert list(automaton.windows(words, n)) == want


def test_repeats_within_one_string():
    assert repeated([b"abcabcab"], 3) == [(0, 0, 8)]
    assert repeated([b"abcd", b"xbcdy"], 3, limit=4) == [(0, 1, 4), (1, 1, 4)]


def test_equal_rows_repeat_each_other(spark):
    text = "".join(random.Random(8).choice("abcdefgh ") for _ in range(649))
    other = text[::-1] + " other"
    for sizes in ({}, {"together": 1}, {"together": 1, "block": 1}):
        check(spark, [(1, text), (1, text)], "doc_id long, text string", **sizes)
        check(spark, [(1, text), (1, text), (None, text), (2, other), (2, other), (None, other), (3, "x" + other[5:400])], "doc_id long, text string", **sizes)


def test_runs_and_short_periods(spark):
    rows = [(1, "-" * 1500), (2, "a" + "-" * 260 + "b"), (3, "=-" * 400), (4, "= " * 300 + "x"), (5, "-" * 199), (6, "ab c" * 90 + "-" * 300), (7, "no run")]
    for sizes in ({}, {"together": 1}):
        check(spark, rows, "doc_id long, text string", **sizes)


def test_what_is_kept_of_equal_windows_covers_them_all():
    import numpy as np

    r = np.random.default_rng(4)
    for length in (1, 2, 7, 200):
        begin = np.flatnonzero(r.random(3000) < 0.7)
        cut = r.integers(0, 3, len(begin)).astype(np.uint64) if length > 1 else np.zeros(len(begin), np.uint64)
        use = passages._needed(cut, begin, length)
        for c in np.unique(cut):
            all_, some = begin[cut == c], begin[use][cut[use] == c]
            assert len(some) >= min(2, len(all_))
            cover = lambda x: {i for b in x for i in range(b, b + length)}
            assert cover(all_) == cover(some)
    assert len(passages._needed(np.zeros(10_000, np.uint64), np.arange(10_000), 200)) < 300


def test_rows_of_a_crowded_anchor_are_few_before_they_are_dealt_out():
    rng = np.random.default_rng(5)
    group = np.append(np.zeros(50_000, np.uint64), rng.integers(1, 5_000, 10_000).astype(np.uint64))
    columns = [rng.integers(-9, 9, len(group)), rng.integers(0, 2**63, len(group)).astype(np.uint64)]
    use = passages._extremes(group, *columns)
    assert (group[use] == 0).sum() <= 4
    for g in np.unique(group):
        for c in columns:
            every, left = c[group == g], c[use][group[use] == g]
            assert (every.min(), every.max(), len(every) > 1) == (left.min(), left.max(), len(left) > 1)
    assert not len(passages._extremes(group[:0], *(c[:0] for c in columns)))


def test_bodies_are_dealt_out_once(spark):
    # before, they went through joins with the anchors and with the crowded ones, and were dealt out by segment and then by anchor
    docs = spark.createDataFrame(brute.documents(4), brute.SCHEMA).selectExpr("xxhash64(doc_id, text) key", "hash(doc_id, text) + 0L rank", "coalesce(text, '') text")
    plan = passages.find(docs, True, 13, 5)._jdf.queryExecution().executedPlan().toString()
    assert [x.strip() for x in re.findall(r"Exchange hashpartitioning\(([a-z, ]+)", re.sub(r"#[0-9]+L?", "", plan))].count("part,") == 1 and len(re.findall("Join", plan)) == 1


def test_shuffles_of_a_stored_table_are_deleted(spark):
    # before, they stayed until the driver collected its garbage
    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (blocks.apply(i) for i in range(blocks.size())) if f.getName().startswith("shuffle_")}

    before = files()
    kept = stored(spark.range(1000, numPartitions=3).groupBy(F.col("id") % 7).count())
    for _ in range(50):
        if not (files() - before):
            break
        time.sleep(0.1)
    assert not (files() - before)
    assert kept.count() == 7
