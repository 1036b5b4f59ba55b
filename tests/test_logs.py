"""Typed logs: written in pieces, read back as they were, newest first, by day."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from concordia.sources import logs


def test_round_trip(spark, tmp_path):
    path = f"{tmp_path}/log"
    at = lambda d, h=0: dt.datetime(2026, 1, d, h)
    rows = [(1, at(1), "A", ["x", None, 'q"'], {"REG": "OK", "INS": None}, "CLEAR"), (2, at(2), None, [], {}, "CLEAR"), (3, at(2), "B", None, None, None), (4, None, "C", ["é"], {"a,b": "{}"}, "x"), (5, at(3, 23), "A", ["y"], {"REG": "DOWN"}, "CLEAR")]
    schema = "id long, ts timestamp_ntz, plate string, requested_attrs array<string>, statuses map<string,string>, decision string"
    for part in (rows[:2], rows[2:]):
        logs.append(logs.QUERIES, spark.createDataFrame(part, schema), path)
    got = logs.read(logs.QUERIES, spark, path)
    assert got.schema.simpleString() == spark.createDataFrame([], logs.QUERIES.schema).schema.simpleString()
    assert sorted((r.id, r.ts, r.plate, r.requested_attrs, r.statuses, r.decision) for r in got.collect()) == sorted(rows)
    assert [r.id for r in logs.newest(logs.QUERIES, got, 3).collect()] == [5, 3, 2]
    assert [r.id for r in logs.newest(logs.QUERIES, got, 9, plate="A").collect()] == [5, 1]
    some = logs.read(logs.QUERIES, spark, path, since="2026-01-02", until="2026-01-02")
    assert {r.id for r in some.collect()} == {2, 3} and "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in logs.newest(logs.QUERIES, got, 3)._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="no columns"):
        logs.append(logs.QUERIES, spark.range(1).withColumn("other", F.lit(1)), path)


def test_nested_details(spark, tmp_path):
    path = f"{tmp_path}/cases"
    e = spark.createDataFrame([(1, 7, dt.datetime(2026, 1, 1), ("ISSUE", "uninsured", 2000)), (2, 8, dt.datetime(2026, 1, 1), None)], "event_id long, case_id long, at timestamp_ntz, detail struct<verdict:string,reason:string,amount_inr:long>")
    logs.append(logs.CASES, e, path)
    got = {r.event_id: r.detail for r in logs.read(logs.CASES, spark, path).collect()}
    assert got[1].amount_inr == 2000 and got[2] is None
    # an old entry without a field, and one with a field more
    spark.range(1).select(F.lit(3).cast("long").alias("event_id"), F.lit('{"verdict":"HOLD","later":1}').alias("detail"), F.lit("2026-01-05").cast("date").alias("day")).write.mode("append").partitionBy("day").parquet(path)
    assert {r.event_id: r.detail for r in logs.read(logs.CASES, spark, path).collect()}[3].verdict == "HOLD"
