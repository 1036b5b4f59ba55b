"""Running values by key and time, fines on joined evidence."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from concordia.operators import adjudicate, cleansing, timeline

DAY = dt.date(2026, 1, 1)


def test_carried_against_a_loop(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot"] * 5 + ["a", None]), r.randint(0, 40), i, r.choice([None, r.randint(0, 99)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    want = {}
    for k, t, i, _ in rows:
        before = sorted((t2, i2, v2) for k2, t2, i2, v2 in rows if k2 == k and (t2, i2) < (t, i) and v2 is not None)
        want[i] = (max((v for _, _, v in before), default=None), before[-1][2] if before else None)
    for width in (1, 7, 1000):
        got = timeline.carried(df, "k", "t", "i", {"top": (F.col("v"), "max"), "newest": (F.col("v"), "last")}, F.expr(f"t div {width}")).collect()
        assert {x.i: (x.top, x.newest) for x in got} == want and len(got) == len(rows)


def test_policy_in_force(spark):
    r = random.Random(4)
    day = lambda: DAY + dt.timedelta(days=r.randint(0, 200))
    policies = [(r.choice("ab"), r.choice([None, day(), day()]), r.choice([None, day(), day(), day()])) for _ in range(60)]
    asked = [(r.choice(["a", "b", "c", None]), day(), i) for i in range(80)] + [("a", None, 99)]
    got = timeline.in_force(spark.createDataFrame(asked, "key string, day date, id int"), "key", "day", spark.createDataFrame(policies, "key string, start date, expiry date")).collect()
    assert len(got) == len(asked)
    for x in got:
        fits = [e for k, s, e in policies if k == x.key and e and x.day and (s is None or s <= x.day) and e >= x.day]
        insured = bool(x.expiry and x.day and x.expiry >= x.day and (x.start is None or x.start <= x.day))
        assert insured == bool(fits) and (not fits or x.expiry == max(fits))


def test_journeys_equal_legs(spark):
    r = random.Random(6)
    at = dt.datetime(2026, 1, 1)
    rows = [(r.choice(["p", "p", "q"]), i, at + dt.timedelta(minutes=r.randint(0, 9000)), 28 + r.random() * 3, 77 + r.random() * 3) for i in range(200)]
    df = spark.createDataFrame(rows, "plate string, id long, at timestamp_ntz, lat double, lon double")
    plain = {x.id: (x.from_id, round(x.km, 6), x.impossible) for x in cleansing.legs(df, "plate", "at", "id").collect()}
    assert {x.id: (x.from_id, round(x.km, 6), x.impossible) for x in timeline.journeys(df, "plate", "at", "id", 160.0).collect()} == plain
    assert timeline.journeys(df.withColumn("plate", F.lit(None).cast("string")), "plate", "at", "id", 160.0).count() == 0


def test_fines(spark):
    at = lambda d, h=10: dt.datetime(2026, 1, d, h)
    seen = [(1, "DL01AB1111", "Kia", "Red", at(5)), (2, "DL01AB2222", None, None, at(5)), (3, "DL01AB3333", None, None, at(5)), (4, "DL01AB4444", None, None, at(5)), (5, "ZZ99ZZ9999", None, None, at(5)), (6, "DLO1AB1111", "Kia", "Red", at(9)), (7, "DL01AB5555", None, None, at(5)), (8, "DL01AB5555", None, None, at(5, 11)), (9, "DLO1AB2222", None, None, at(6)), (10, "DL01AB1111", None, None, at(20))]
    cases = spark.createDataFrame([(*x, 28.6 if x[0] != 8 else 12.9, 77.2) for x in seen], "case_id int, read string, observed_make string, observed_colour string, at timestamp_ntz, lat double, lon double")
    official = spark.createDataFrame([("DL01AB1111", "Kia", "Red", "ACTIVE"), ("DL01AB2222", "Tata", "Blue", "ACTIVE"), ("DL01AB3333", "Tata", "Blue", "SUSPENDED"), ("DL01AB4444", "Tata", "Blue", "ACTIVE"), ("DL01AB5555", "Tata", "Blue", "ACTIVE")], "key string, vehicle_make string, vehicle_colour string, registration_status string")
    thefts = spark.createDataFrame([("DL01AB4444", "STOLEN", dt.date(2026, 1, 5)), ("DL01AB2222", "STOLEN", dt.date(2026, 2, 1))], "key string, stolen_status string, last_incident_date date")
    d = lambda day: dt.date(2026, 1, day)
    policies = spark.createDataFrame([("DL01AB1111", d(1), d(4)), ("DL01AB1111", d(10), d(30)), ("DL01AB2222", None, d(5)), ("DL01AB2222", dt.date(2025, 1, 1), dt.date(2025, 2, 1))], "key string, insurance_start date, insurance_expiry date")
    got = {r.case_id: (r.verdict, r.reason, r.amount_inr) for r in adjudicate.verify(adjudicate.evidence(cases, official, thefts, policies)).collect()}
    assert got == {
        1: ("ISSUE", "uninsured on the day", 2000), 2: ("REJECT", "insured on the day", None), 3: ("REJECT", "registration offence", None), 4: ("REJECT", "stolen before sighting", None), 5: ("REJECT", "no registered match", None),
        6: ("ISSUE", "uninsured on the day", 4000), 7: ("HOLD", "impossible travel", None), 8: ("HOLD", "impossible travel", None), 9: ("HOLD", "ambiguous identity", None), 10: ("REJECT", "insured on the day", None),
    }
    down = adjudicate.verify(adjudicate.evidence(cases, official, thefts, policies, ["INS"]))
    assert {(r.verdict, r.reason) for r in down.collect()} == {("HOLD", "sources unreachable")}
    assert adjudicate.verify(adjudicate.evidence(cases.filter("false"), official, thefts, policies)).count() == 0


def test_fines_try_all_variants_of_a_read(spark):
    """The registered plate is the last of 16 versions of its read."""
    cases = spark.createDataFrame([(1, "DL00AB001O", "Kia", "Red", dt.datetime(2026, 1, 5), 28.6, 77.2)], "case_id int, read string, observed_make string, observed_colour string, at timestamp_ntz, lat double, lon double")
    official = spark.createDataFrame([("DL00AB0010", "Kia", "Red", "ACTIVE")], "key string, vehicle_make string, vehicle_colour string, registration_status string")
    none = spark.createDataFrame([], "key string, stolen_status string, last_incident_date date, insurance_start date, insurance_expiry date")
    got = adjudicate.verify(adjudicate.evidence(cases, official, none, none)).first()
    assert (got.resolved, got.verdict, got.amount_inr) == ("DL00AB0010", "ISSUE", 2000)


def test_prevented(spark):
    df = spark.createDataFrame([(s,) for s in ("ISSUED", "REJECTED", "CANCELLED", "REJECTED", "HOLD")], "status string")
    assert {r.status: r.n for r in adjudicate.prevented(df).collect()}["PREVENTED"] == 3


def test_failures():
    from concordia.plans import mediate
    from concordia.sources import sample

    assert mediate.failures(sample.registry(), {"INS": "TIMEOUT", "CAM": "DOWN", "REG": "OK", "THEFT": "DOWN"}) == ["INS", "THEFT"]


@pytest.mark.parametrize("every", [False, True])
def test_all_rows_of_a_key(spark, every):
    from concordia.plans import mediate
    from concordia.sources import sample

    t = sample.tables(spark, "/root/testdata/sf0.001")
    got = mediate.unfold(sample.registry().source("CAM"), t, {"last_seen_time"}, every=every)
    assert (got.count() > got.select("key").distinct().count()) == every


def test_evidence_reads_its_sources_once(spark):
    read = {n: spark.sparkContext.accumulator(0) for n in ("cases", "policies")}

    def counted(df, name, column, kind):
        def touch(v):
            read[name].add(1)
            return v

        return df.withColumn(column, F.udf(touch, kind).asNondeterministic()(column))

    d = dt.date(2026, 1, 1)
    cases = spark.createDataFrame([(i, f"DL01AB111{i}", None, None, dt.datetime(2026, 1, 5), 28.6, 77.2) for i in range(5)], "case_id int, read string, observed_make string, observed_colour string, at timestamp_ntz, lat double, lon double")
    official = spark.createDataFrame([(f"DL01AB111{i}", "Kia", "Red", "ACTIVE") for i in range(5)], "key string, vehicle_make string, vehicle_colour string, registration_status string")
    policies = spark.createDataFrame([("DL01AB1111", d, d)] * 4, "key string, insurance_start date, insurance_expiry date")
    thefts = spark.createDataFrame([], "key string, stolen_status string, last_incident_date date")
    out = adjudicate.verify(adjudicate.evidence(counted(cases, "cases", "read", "string"), official, thefts, counted(policies, "policies", "insurance_start", "date")))
    assert out.count() == len(out.collect()) == 5
    assert read["policies"].value == 4 and read["cases"].value <= 10
