"""Record repair on a fixture whose result is known, matcher included."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from concordia.operators import repair
from concordia.operators.rules import Tree

COLUMNS = "record_id long, plate_number string, observed_make string, observed_model string, observed_colour string, last_seen_time string, location string, lat double, lon double, ocr_confidence double"


def fixture(spark):
    makes, colours = ["Kia", "Tata", "Ford"], ["Red", "Blue", "Grey"]
    cars = [("DL01AB1234", "Kia", "Rio", "Red"), *((f"HR26EF{4000 + 111 * i}", makes[i % 3], ["Rio", "Nexon", "Figo"][i % 3], colours[i % 3]) for i in range(30))]
    t = "2026-01-01T10:00:00"
    rows = [
        (1, "DL01AB1234", "Kia", "Rio", "Red", t, "a", 28.6, 77.2, 0.95),
        (2, "DL01AB1234", "Kia", "Rio", "Red", t, "a", 28.6, 77.2, 0.95),
        (3, "HR26EF4000", "KIA", "Rio", "Redd", "01/01/2026 11:00:00", "a", 28.6, 77.2, 0.95),
        (4, "HR26EF4111", "Zzzzz", "Nexon", "Blue", "no time", "a", 28.6, 77.2, 0.5),
        (5, "HR26EF4222", "Kia", "Figo", "Red", t, "a", 28.6, 77.2, 0.5),
        (6, "DLO1AB1234", "Kia", "Rio", "Red", "2026-01-02T10:00:00", "b", 28.6, 77.2, 0.95),
        (7, "QQ99QQ9999", None, None, None, None, None, None, None, None),
        (8, None, "", "", "", "", "", 0.0, 0.0, 0.1),
        (9, "HR26EF4333", "Kia", "Rio", "Red", t, "a", 28.6, 77.2, 0.9),
        (10, "HR26EF4333", "Kia", "Rio", "Red", "2026-01-01T10:30:00", "b", 12.9, 77.6, 0.9),
    ]
    cars = spark.createDataFrame(cars, "key string, make string, model string, colour string")
    return spark.createDataFrame(rows, COLUMNS), repair.known(cars, "2026-06-01 00:00:00")


def test_repair(spark):
    records, of = fixture(spark)
    done = repair.repair(records, of, match={"edits": 1})
    fixes = {(r.record_id, r.field): (r.rule, r.action, r.set_to) for r in done.proposals.filter("round = 1 and action <> 'keep'").collect()}
    assert fixes[(2, "record")][:2] == ("R11", "delete") and (1, "record") not in fixes
    assert fixes[(3, "observed_make")] == ("R1", "set", "Kia") and fixes[(3, "observed_colour")] == ("R1", "set", "Red") and fixes[(3, "last_seen_time")] == ("R9", "set", "2026-01-01T11:00:00")
    assert fixes[(4, "observed_make")] == ("R3", "set", "Tata") and fixes[(4, "last_seen_time")][:2] == ("R10", "quarantine") and (4, "plate_number") not in fixes
    assert fixes[(5, "plate_number")][:2] == ("R7", "quarantine") and fixes[(5, "observed_colour")] == ("R4", "flag", "CLONE_SUSPECT")
    assert fixes[(6, "plate_number")] == ("R5", "set", "DL01AB1234") and fixes[(7, "plate_number")][:2] == ("R6", "quarantine")
    assert fixes[(9, "record")] == fixes[(10, "record")] == ("R4", "flag", "CLONE_SUSPECT")
    end = {r.record_id: r for r in done.records.collect()}
    assert sorted(end) == [1, 3, 4, 5, 6, 7, 8, 9, 10] and end[6].plate_number == "DL01AB1234" and end[3].observed_colour == "Red" and end[8].observed_make == ""
    after = {r.record_id: r.anomalies for r in done.after.collect()}
    assert after[1] == after[3] == after[6] == [] and after[4] == ["TIMESTAMP_UNPARSEABLE"] and "IMPOSSIBLE_TRAVEL" in after[9]
    assert {r.record_id: r.anomalies for r in done.before.collect()}[3] == ["MAKE_NOT_IN_LEXICON", "COLOUR_NOT_IN_LEXICON", "TIMESTAMP_NONSTANDARD"]
    got = {(r.record_id, r.code): r.disposition for r in repair.dispositions(done, spark.createDataFrame([(9, ["IMPOSSIBLE_TRAVEL"])], "record_id long, codes array<string>")).collect()}
    assert got[(9, "IMPOSSIBLE_TRAVEL")] == "resolved" and got[(10, "IMPOSSIBLE_TRAVEL")] == "flagged" and got[(4, "TIMESTAMP_UNPARSEABLE")] == "quarantined"
    # what is repaired stays so
    again = repair.repair(done.records, of, match={"edits": 1})
    assert again.rounds == 0 and {(r.record_id, *r.anomalies) for r in again.before.collect()} == {(r.record_id, *r.anomalies) for r in done.after.collect()}


def test_rounds_are_bounded_and_empty_tables_pass(spark):
    records, of = fixture(spark)
    swing = Tree({"id": "a", "condition": {"field": "field", "op": "eq", "value": "observed_make"}, "conclusion": {"action": "set", "value": "Kia"}, "except": {"id": "b", "condition": {"field": "value", "op": "eq", "value": "Kia"}, "conclusion": {"action": "set", "value": "Tata"}}})
    assert repair.repair(records, of, swing, most=2).rounds == 2
    none = repair.repair(records.filter("false"), of)
    assert none.rounds == 0 and none.records.count() == none.after.count() == repair.rollup(none).count() == 0


def test_rows_of_one_id_are_changed_alike(spark):
    """Two rows of one id that set the same field: neither fails nor multiplies what is resolved."""
    records, of = fixture(spark)
    twice = records.filter("record_id <> 10").withColumn("record_id", F.when(F.col("record_id") == 4, 3).otherwise(F.col("record_id")))
    done = repair.repair(twice, of)
    assert {(r.plate_number, r.observed_make) for r in done.records.filter("record_id = 3").collect()} == {("HR26EF4000", "Tata"), ("HR26EF4111", "Tata")}
    ruled = spark.createDataFrame([(3, ["TIMESTAMP_UNPARSEABLE"]), (3, ["X"])], "record_id long, codes array<string>")
    left = done.after.select("record_id", F.explode("anomalies").alias("code")).filter("record_id = 3")
    got = repair.dispositions(done, ruled).filter("record_id = 3 and code = 'TIMESTAMP_UNPARSEABLE'").collect()
    rows = done.proposals.filter((F.col("round") == done.rounds + 1) & (F.col("record_id") == 3) & (F.col("field") == "last_seen_time")).count()
    assert len(got) == rows * left.filter("code = 'TIMESTAMP_UNPARSEABLE'").count() and {r.disposition for r in got} <= {"resolved"}


def test_records_are_read_once(spark):
    records, of = fixture(spark)
    read = spark.sparkContext.accumulator(0)

    def touch(v):
        read.add(1)
        return v

    enriched = repair.enrich(records.withColumn("last_seen_time", F.udf(touch, "string").asNondeterministic()("last_seen_time")), of)
    assert enriched.count() == len(enriched.collect()) == 10
    assert read.value == 10


@pytest.mark.parametrize("query", ["record_repair", "record_dispositions", "suggestions"])
def test_repairs_are_made_once(spark, tmp_path, query):
    """Two captures of one car at one place and second, whose times have two forms, are only copies once the times are put right: what is left, not a second repair."""
    import duckdb

    from concordia.plans import casework

    at = dt.datetime(2024, 1, 5, 10)
    events = [(18, at, 5, "view", 90.0), (25, at, 5, "view", 90.0), (26, at, 6, "view", 90.0)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for t in ("customer", "nation", "region", "orders"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path)
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = sorted(map(tuple, casework.QUERIES[query](spark, str(tmp_path)).collect()))
    assert got and got == sorted(db.execute(casework.ORACLE_SQL[query]).fetchall())
