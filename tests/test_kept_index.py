"""The kept index: the same candidates as built anew, after changes and in another session, without shuffling the index."""

import random

from pyspark.sql import functions as F

from concordia.operators import blocking
from concordia.operators.kept_index import KeptIndex


def plates(n, seed):
    r = random.Random(seed)
    return [f"DL{r.randint(0, 99):02d}{r.choice('ABC')}{r.choice('ABC')}{r.randint(0, 9999):04d}" for _ in range(n)]


def test_same_candidates_through_changes(spark, tmp_path):
    first, second = plates(400, 1), plates(400, 1)[50:] + plates(60, 2)
    reads = spark.createDataFrame([(p[:5] + p[6:],) for p in first[::40]] + [(p[:-1] + "7",) for p in second[::40]] + [(None,), ("",), ("ZZZZ",)], "read string")
    index = KeptIndex(spark, f"{tmp_path}/i", "plates_a", buckets=4)
    pairs = lambda df: {(r.read, r.key, r.shared) for r in df.collect()}
    assert pairs(index.candidates(reads, "read")) == set()
    for rows, moved in ((first, None), (second, None), (first[:10], None), (first, None), (first, (0, 0))):
        registry = spark.createDataFrame([(p,) for p in rows] + [(None,), (" ",)], "key string")
        before = {r.key for r in index.keys().collect()}
        assert index.refresh(registry, "key") == (moved or (len(set(rows) - before), len(before - set(rows))))
        assert pairs(index.candidates(reads, "read")) == pairs(blocking.candidates(reads, "read", registry, "key", "prefix"))
    entries = spark.table("plates_a_entries")
    assert entries.count() == entries.distinct().count()
    spark.sql("DROP TABLE plates_a_entries")
    spark.sql("DROP TABLE plates_a_ranks")
    spark.sql("DROP TABLE plates_a_keys")
    again = KeptIndex(spark, f"{tmp_path}/i", "plates_b", buckets=4)
    assert pairs(again.candidates(reads, "read")) == pairs(blocking.candidates(reads, "read", registry, "key", "prefix"))


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = KeptIndex(spark, f"{tmp_path}/j", "plates_c", buckets=4)
    index.refresh(spark.createDataFrame([(p,) for p in plates(50, 3)], "key string"), "key")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.candidates(spark.createDataFrame([("DL01AB1234",)], "read string"), "read")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "plates_c_entries" in x)
    above = [x.strip(" :+-*()0123456789") for x in lines[at - 3 : at]]
    assert "Bucketed: true" in lines[at] and not any("Exchange" in x for x in above)


def test_another_tokenizer(spark, tmp_path):
    pieces = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Z]+|[0-9]+"), F.lit(0)))
    index = KeptIndex(spark, f"{tmp_path}/k", "plates_d", tokenizer=pieces, per_edit=1, buckets=2)
    index.refresh(spark.createDataFrame([("DL01AB1234",), ("HR26EF4455",)], "key string"), "key")
    got = index.candidates(spark.createDataFrame([("DL01AB1299",)], "read string"), "read", 1).collect()
    assert [(r.key, r.shared) for r in got] == [("DL01AB1234", 3)]
