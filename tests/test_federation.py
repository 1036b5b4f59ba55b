"""Databases as sources, and sources that hang or are down."""

import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from concordia.plans import mediate
from concordia.sources import database, tables

KEYS = ["DL-01-AB-1234", "dl 01 ab 1234", "DLO1AB1234", "HR26EF4455", None, "it's"]


@pytest.fixture(scope="module")
def db(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "cars.db")
    con = sqlite3.connect(path)
    con.execute('CREATE TABLE "cars" (id INTEGER, plate TEXT, price REAL, extra BLOB)')
    con.executemany("INSERT INTO cars VALUES (?, ?, ?, ?)", [(i if i % 50 else None, KEYS[i % 6], i / 4, b"x") for i in range(25_000)])
    con.commit()
    con.close()
    return {"database": path}


SCHEMA = "id long, plate string, price double"


def test_ranges_read_all_rows(spark, db):
    whole = database.read(spark, SCHEMA, "cars", db)
    parted = database.read(spark, SCHEMA, "cars", db, key="id", parts=7)
    assert parted.rdd.getNumPartitions() == 8 and whole.count() == parted.count() == 25_000
    assert parted.select(F.sum("price"), F.count("id")).first() == whole.select(F.sum("price"), F.count("id")).first()
    assert parted.exceptAll(whole).count() == 0


@pytest.mark.parametrize("condition", ["id > 100 and id <= 9000", "plate = \"it's\"", "plate in ('HR26EF4455', 'DLO1AB1234') and price >= 3.5", "plate is null", "not plate = 'HR26EF4455'", "plate like 'DL%' and id < 77", "id % 7 = 3", "plate is not null and length(plate) = 4"])
def test_filters_are_pushed(spark, db, condition):
    got = database.read(spark, SCHEMA, "cars", db, key="id", parts=3).filter(condition)
    want = spark.createDataFrame([(i if i % 50 else None, KEYS[i % 6], i / 4) for i in range(25_000)], SCHEMA).filter(condition)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("Filter " in plan) == ("%" in condition and "like" not in condition or "length" in condition)


def test_a_filter_reaches_the_database(spark, db):
    reader = database.Reader(spark.createDataFrame([], SCHEMA).schema, {"connect": "{}", "table": "cars", "where": "1=1"})
    from pyspark.sql import datasource as D

    left = list(reader.pushFilters([D.EqualTo(("plate",), "it's"), D.StringContains(("plate",), "x"), D.In(("id",), (1, 2)), D.GreaterThan(("a", "b"), 1)]))
    assert reader.where == ["1=1", "\"plate\" = 'it''s'", '"id" IN (1, 2)'] and len(left) == 2


def test_key_predicates(spark, db):
    b = database.Builder()
    count = lambda where: database.read(spark, SCHEMA, "cars", db, where=where).select("plate").distinct().count()
    assert count(b.key("plate", "DL01AB1234")) == 2 and count(b.folded("plate", "DL01AB1234")) == 3
    assert count(b.rendered("plate", "DL-01-AB-1234")) == 1 and count(b.one_of("plate", "DL01AB1234")) == 3
    assert count(b.near("plate", "DL01AB1234")) == 3 and count(b.rendered("plate", "x' OR '1'='1")) == 0


class Upper(database.Builder):
    def name(self, column):
        return super().name(column.upper())


def test_another_builder(spark, db):
    assert database.read(spark, SCHEMA, "cars", db, builder=f"{__name__}:Upper").count() == 25_000
    broken = database.read(spark, SCHEMA, "nothing", db)
    assert tables.probe(broken) == "ERROR"


def hanging(spark):
    def wait(batches):
        for b in batches:
            time.sleep(120)
            yield b

    return spark.range(1).mapInPandas(wait, "id long")


def test_probes_keep_to_their_deadline(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    gone = spark.read.parquet(f"{tmp_path}/t")
    for f in (tmp_path / "t").glob("*.parquet"):
        f.unlink()

    def refuses():
        raise ConnectionRefusedError("nobody listens")

    began = time.time()
    got = tables.probes({"ok": spark.range(2), "empty": spark.range(0), "slow": hanging(spark), "late": lambda: time.sleep(60), "gone": gone, "off": refuses, "bad": spark.range(1).select(F.raise_error(F.lit("no")))}, 20)
    assert time.time() - began < 45
    assert got == {"ok": "OK", "empty": "OK", "slow": "TIMEOUT", "late": "TIMEOUT", "gone": "DOWN", "off": "DOWN", "bad": "ERROR"}


def test_a_source_that_hangs_costs_its_deadline(spark):
    from concordia.sources import sample

    t = sample.tables(spark, "/root/testdata/sf0.001")
    asked = {**t, "CRIME": hanging(spark).select(*(F.lit(None).cast(x.dataType).alias(x.name) for x in t["CRIME"].schema))}
    began = time.time()
    out = mediate.ask(sample.registry(), asked, ("stolen_status", "registration_status", "insurance_status"), sample.TODAY, keys=spark.createDataFrame([("DL00AB0001",)], "key string"), deadline=15)
    rows = out.collect()
    assert time.time() - began < 90
    assert rows[0].availability["THEFT"] == "TIMEOUT" and rows[0].stolen_status == "UNKNOWN" and rows[0].decision == "UNDETERMINED"
