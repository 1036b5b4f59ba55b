import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from concordia.plans import console, mediate
from concordia.plans.oracle import ORACLE_SQL
from concordia.plans.queries import QUERIES
from concordia.sources import registry as R
from concordia.sources import sample
from concordia.sources import tables as sinks
from concordia.sources.registry import Lookup, Mapping, RegistryError, Source

TODAY = "2026-09-04"


@pytest.fixture(scope="module")
def stories(spark):
    frame = spark.createDataFrame
    return {
        "VEHICLE": frame([(1, "DL01AB1234", 1, "tata", "nexon", "white", "ACT"), (2, "DL05CD9876", 2, "kia", "seltos", "red", "ACT"), (3, "HR26EF4455", 9, "honda", "city", "black", "ACT"), (4, "UP16GH1122", 1, "tata", "punch", "blue", "ACT")], "registration_id int, registration_no string, owner_id int, make string, model string, colour string, reg_status string").withColumns({"registered_on": F.current_date(), "rto_code": F.lit("x")}),
        "OWNERS": frame([(1, "asha o'neil", 1), (2, "b", 1)], "owner_id int, full_name string, region_id int"), "PLACES": frame([(1, "delhi")], "region_id int, city string"),
        "POLICY": frame([(1, "DL-01-AB-1234", "04/09/2024"), (2, "DL-01-AB-1234", "13/11/2026"), (3, "DL-05-CD-9876", "01/01/2026"), (4, "HR-26-EF-4455", "01/01/2027"), (5, "UP-16-GH-1122", "01/01/2027")], "policy_id int, vehicle_reg string, policy_until string").withColumns({"policy_type": F.lit("C"), "policy_start": F.lit("01/01/2020"), "premium_inr": F.lit(1.0)}),
        "CRIME": frame([(1, "hr 26 ef 4455", 1739232000, "N", "closed"), (2, "hr 26 ef 4455", 1755216000, "N", "open")], "incident_id int, vehicle_number string, reported_date long, recovered_flag string, case_status string").withColumns({"stolen_flag": F.lit("Y"), "incident_type": F.lit("THEFT")}),
        "CAPTURES": frame([(1, "DL01AB1234", 1, "2026-09-01T10:00:00", "Tata", "Nexon", "White"), (2, "UP16GH1122", 1, "2026-09-01T10:00:00", "Honda", "City", "Blue"), (3, "MH12IJ7788", 1, "2026-09-01T10:00:00", None, None, None)], "capture_id int, plate_id string, camera_id int, captured_at string, observed_make string, observed_model string, observed_colour string").withColumn("ocr_confidence", F.lit(0.9)),
        "CAMERAS": frame([(1, "north gate")], "camera_id int, location_name string"),
    }


def ask(stories, spark, plates=None, **more):
    keys = spark.createDataFrame([(p,) for p in plates], "key string") if plates else None
    return {r.key: r for r in mediate.ask(sample.registry(), stories, sample.ATTRIBUTES, TODAY, keys, **more).collect()}


def test_stories(spark, stories):
    got = ask(stories, spark)
    assert {k: (r.decision, r.confidence) for k, r in got.items()} == {
        "DL01AB1234": ("CLEAR", "HIGH"), "DL05CD9876": ("UNINSURED — REPORT", "HIGH"), "HR26EF4455": ("STOLEN — ALERT POLICE", "HIGH"), "UP16GH1122": ("SUSPICIOUS — POSSIBLE CLONED PLATE", "MEDIUM"), "MH12IJ7788": ("UNREGISTERED / SUSPICIOUS", "MEDIUM")}
    r = got["DL01AB1234"]
    assert str(r.insurance_expiry) == "2026-11-13" and r.owner_name == "Asha O'Neil" and r.provenance["last_seen_location"].source == "CAM"
    assert str(got["HR26EF4455"].last_incident_date) == "2025-08-15" and got["HR26EF4455"].owner_name is None
    assert len(got["UP16GH1122"].conflicts) == 2


def test_one_key_in_any_spelling_and_unknown_ones(spark, stories):
    got = ask(stories, spark, ["dl 01-ab 1234", "ZZ99ZZ9999"])
    assert set(got) == {"DL01AB1234", "ZZ99ZZ9999"} and got["ZZ99ZZ9999"].decision == "UNKNOWN VEHICLE — NOT REGISTERED"


@pytest.mark.parametrize("down", ["INS", "THEFT"])
def test_a_failed_source_is_no_absence(spark, stories, down):
    assert {r.decision for r in ask(stories, spark, status={down: "DOWN"}).values()} == {"UNDETERMINED"}
    got = ask(stories, spark, status={"REG": "TIMEOUT"})
    assert got["MH12IJ7788"].decision == "UNDETERMINED" and got["DL01AB1234"].risk >= 10


def test_narrow_questions_ask_few(spark, stories):
    reg = sample.registry()
    assert mediate.choose(reg, ["insurance_status"])[0] == ["REG", "INS"] and mediate.choose(reg, ["case_status"])[0] == ["THEFT"]
    r = mediate.ask(reg, stories, ["case_status"], TODAY).filter("key = 'HR26EF4455'").first()
    assert r.case_status == "OPEN" and "REG" not in r.availability
    with pytest.raises(RegistryError):
        mediate.choose(reg, ["no_such"])


def test_unneeded_joins_are_left_out(spark, stories):
    plan = mediate.unfold(sample.registry().source("CAM"), stories, {"observed_make"})._jdf.queryExecution().optimizedPlan().toString()
    assert "location_name" not in plan and "Join" not in plan


def test_registry_rules(tmp_path):
    key = Mapping("T", "c", "plate_number")
    for bad in (lambda: Mapping("T", "c; drop", "x"), lambda: Source("A", "T", (Mapping("T", "c", "owner_name"),)), lambda: Source("A", "T", (key,), trust=2), lambda: Source("A", "T", (key, Mapping("U", "d", "owner_name"))), lambda: R.Registry((Source("A", "T", (key,)), Source("A", "T", (key,)))), lambda: R.Registry((Source("A", "T", (key, Mapping("T", "d", "nothing"))),)), lambda: Source("A", "T", (key,), (Lookup("V", "a", "U", "a"),))):
        with pytest.raises(RegistryError):
            bad()
    (tmp_path / "r.json").write_text(json.dumps({"sources": {"A": {"trust": 95, "authority": "OBSERVATIONAL", "mappings": [{"source_table": "T", "source_attr": "c", "global_attr": "plate_number"}, {"source_table": "T", "source_attr": "z"}]}}}))
    s = R.load(tmp_path / "r.json").sources[0]
    assert (s.trust, s.authority, s.main, len(s.mappings)) == (0.95, "observational", "T", 1)


def test_csv_and_sinks(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "x.csv").write_text("id,n,d\n1, 5 ,2026-01-02\nx,,bad\n")
    df = sinks.read_csv(spark, f"file://{tmp_path}/x.csv", T.StructType().add("id", "integer").add("n", "integer").add("d", "date"))
    assert [tuple(map(str, r)) for r in df.collect()] == [("1", "5", "2026-01-02"), ("None", "None", "None")]
    assert sinks.probe(df) == "OK"
    sinks.append(df, f"{tmp_path}/log")
    sinks.append(df, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    assert {r.column: r.type for r in sinks.describe(df).collect()} == {"id": "int", "n": "int", "d": "date"}


def test_console(spark):
    t = {"t": spark.range(3).withColumnRenamed("id", "n")}
    assert console.query(spark, "SELECT count(*) AS c, 'insert; --' AS s FROM t;", t).first().c == 3
    other = "parquet.`/root/testdata/sf0.001/nation.parquet`"
    spark.range(1).createOrReplaceTempView("hidden")
    for bad in ("DROP TABLE t", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "SELECT nothing FROM t", f"SELECT * FROM {other}", f"SELECT * FROM t WHERE n IN (SELECT n_nationkey FROM {other})", f"WITH t AS (SELECT * FROM {other}) SELECT * FROM t", "SELECT * FROM hidden", "SELECT * FROM range(5)", "SELECT (SELECT max(id) FROM hidden) FROM t"):
        with pytest.raises(console.Refused):
            console.query(spark, bad, t)
    for call in ("reflect('java.lang.System', 'getenv', 'HOME')", "java_method('java.lang.System', 'getenv', 'HOME')", "try_reflect('java.lang.System', 'getenv', 'HOME')", "upper(`reflect`('java.util.UUID', 'randomUUID'))", "system.builtin.Reflect('java.util.UUID', 'randomUUID')", "current_user()", "input_file_name()"):
        for sql in (f"SELECT {call} AS x FROM t", f"SELECT n FROM t WHERE {call} IS NOT NULL", f"WITH w AS (SELECT {call} AS x) SELECT * FROM w", f"SELECT (SELECT max({call}) FROM t) AS x"):
            with pytest.raises(console.Refused, match="function"):
                console.query(spark, sql, t)
    assert console.query(spark, "SELECT 'reflect(1)' AS s FROM t", t).first().s == "reflect(1)"
    # the caller's own view of that name stays, and no view is left behind
    spark.range(7).createOrReplaceTempView("t")
    assert console.query(spark, "WITH x AS (SELECT n FROM t) SELECT count(*) AS c FROM x JOIN T USING (n)", {**t, "u": t["t"]}).first().c == 3
    assert spark.table("t").count() == 7 and not spark.catalog.tableExists("u")
    spark.catalog.dropTempView("t")
    spark.catalog.dropTempView("hidden")


def _plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    return round(float(v), 6) if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else str(v)


@pytest.mark.parametrize("name", [q for q in QUERIES if q in ORACLE_SQL])
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    plain = lambda df: sorted(repr([_plain(v) for v in row]) for row in df[sorted(df.columns)].itertuples(index=False))
    assert plain(got) == plain(want)


def test_streams(spark, tmp_path):
    import datetime as dt

    from concordia.streaming import captures as S

    at = dt.datetime(2026, 1, 1, 10)
    rows = [("p", 1, "a", at, 28.6, 77.2), ("p", 2, "b", at + dt.timedelta(minutes=20), 26.9, 75.8), ("p", 1, "a", at, 28.6, 77.2), ("q", 3, "a", at, 28.6, 77.2)]
    schema = "plate_id string, capture_id long, location string, at timestamp, lat double, lon double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def drain(df, mode):
        name = f"s{abs(hash((mode, df.columns.__str__())))}"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name).collect()

    assert len(drain(S.without_duplicates(stream()), "append")) == 3
    assert sum(r.n for r in drain(S.per_window(stream()), "complete")) == 4
    assert {r.plate_id: r.capture_id for r in drain(S.latest(stream()), "complete")} == {"p": 2, "q": 3}
    found = drain(S.impossible_journeys(stream()), "append")
    assert [r.plate_id for r in found] == ["p"] and found[0].kmh > 160


def test_describe_reads_all_rows(spark):
    df = spark.range(30_000, 0, -1, 1).selectExpr("lpad(id, 6, '0') k", "id % 3 n", "array(id) a")
    got = {r.column: r.samples for r in sinks.describe(df).collect()}
    assert got == {"k": [f"{i:06d}" for i in range(1, 21)], "n": ["0", "1", "2"], "a": []}
