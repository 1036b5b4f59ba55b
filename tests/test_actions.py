"""Named writes: each does what it says for many requests at once, and is undone."""

import pytest
from pyspark.sql import functions as F

from concordia.sources import actions


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "OWNERS": make([(1, "A", 1), (2, "B", 1), (3, "nobody's", 1)], "owner_id long, full_name string, region_id long"),
        "VEHICLE": make([(1, "DL01AB1111", 1, "Kia", "Rio", "Red", None, "ACT", "DL01"), (2, "DL01AB2222", 1, "Kia", "Rio", "Red", None, "SUSP", "DL01"), (7, "HR26EF4455", 2, "Tata", "Nexon", "Blue", None, "ACT", "HR26"), (9, "KA01ZZ0001", None, "Tata", "Nexon", "Blue", None, "ACT", "KA01")], "registration_id long, registration_no string, owner_id long, make string, model string, colour string, registered_on date, reg_status string, rto_code string"),
        "POLICY": make([(5, "DL-01-AB-1111", "THIRD", "01/01/2020", "01/01/2021", 0, 1.0), (6, "DL-01-AB-1111", "THIRD", "01/01/2022", "01/01/2023", 0, 1.0), (8, "HR-26-EF-4455", "THIRD", None, None, 1, None)], "policy_id long, vehicle_reg string, policy_type string, policy_start string, policy_until string, is_active int, premium_inr double"),
        "CRIME": make([(1, "dl 01 ab 1111", 0, "THEFT", "Y", "N", "open"), (2, "dl 01 ab 1111", 0, "SHREDDING", "N", "N", "CLOSED")], "incident_id long, vehicle_number string, reported_date long, incident_type string, stolen_flag string, recovered_flag string, case_status string"),
        "CAPTURES": make([(1, "DL01AB1111", 3, "2024-01-01T00:00:00", "Kia", "Rio", "Red", 0.5)], "capture_id long, plate_id string, camera_id int, captured_at string, observed_make string, observed_model string, observed_colour string, ocr_confidence double"),
        "CERTS": make([], "cert_no long, regn_number string, valid_upto date, tested_at string, emission_norm string"),
    }


def content(tables):
    return {t: sorted(map(repr, df.collect())) for t, df in tables.items()}


def asked(spark, *rows, columns="plate string"):
    return spark.createDataFrame([*rows], columns)


@pytest.mark.parametrize("name", sorted(actions.ACTIONS))
def test_every_action_is_undone(spark, tables, name):
    requests = asked(spark, ("dl-01-ab-1111",), ("HR26EF4455",), ("XX00XX0000",), (None,), ("",))
    write = actions.perform(name, tables, requests)
    after = write.apply(tables)
    before, changed = content(tables), content(after)
    assert changed != before or name in ("revoke", "set_status")
    assert content(write.undo(after)) == before
    assert {t for t in before if before[t] != changed[t]} <= set(write.ids)


def test_register_and_unregister(spark, tables):
    requests = asked(spark, ("zz 99", "Kia"), ("aa11", None), ("mm55", "Ford"), columns="plate string, make string")
    after = actions.perform("register", tables, requests).apply(tables)
    new = {r.registration_no: r for r in after["VEHICLE"].filter("registration_id > 9").collect()}
    assert {p: (r.registration_id, r.owner_id, r.make, r.reg_status, r.rto_code) for p, r in new.items()} == {"AA11": (10, 4, "Maruti Suzuki", "ACT", "AA11"), "MM55": (11, 5, "Ford", "ACT", "MM55"), "ZZ99": (12, 6, "Kia", "ACT", "ZZ99")}
    assert after["OWNERS"].count() == 6
    off = actions.perform("unregister", tables, asked(spark, ("DL01AB1111",), ("HR26EF4455",), ("KA01ZZ0001",)))
    left = off.apply(tables)
    assert {r.registration_id for r in left["VEHICLE"].collect()} == {2} and {r.owner_id for r in left["OWNERS"].collect()} == {1, 3}


def test_values_and_spellings(spark, tables):
    renewed = actions.perform("renew", tables, asked(spark, ("DL01AB1111", "05/05/2030"), columns="plate string, policy_until string")).apply(tables)
    assert {(r.policy_id, r.policy_until, r.is_active) for r in renewed["POLICY"].filter("policy_id < 7").collect()} == {(5, "05/05/2030", 1), (6, "05/05/2030", 1)}
    assert actions.perform("steal", tables, asked(spark, ("HR26EF4455",))).added["CRIME"].first().vehicle_number == "hr 26 ef 4455"
    assert actions.perform("add_policy", tables, asked(spark, ("HR26EF4455",))).added["POLICY"].first()[:2] == (9, "HR-26-EF-4455")
    assert {r.incident_type for r in actions.perform("clear", tables, asked(spark, ("DL01AB1111",))).apply(tables)["CRIME"].collect()} == {"SHREDDING"}
    with pytest.raises(ValueError, match="no action"):
        actions.perform("burn", tables, asked(spark, ("X",)))


def test_undo_leaves_what_was_changed_since(spark, tables):
    write = actions.perform("set_status", tables, asked(spark, ("DL01AB1111", "SUSP"), ("HR26EF4455", "SUSP"), columns="plate string, reg_status string"))
    after = write.apply(tables)
    later = {**after, "VEHICLE": after["VEHICLE"].withColumn("reg_status", F.when(F.col("registration_id") == 7, "CANC").otherwise(F.col("reg_status")))}
    assert {r.registration_id: r.reg_status for r in write.undo(later)["VEHICLE"].collect()} == {1: "ACT", 2: "SUSP", 7: "CANC", 9: "ACT"}


def test_numbers_are_dense_over_partitions(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 as k").repartition(13)
    got = [(r.k, r.n) for r in actions.numbered(rows, "k", 5, "n").collect()]
    assert sorted(got) == [(k, k + 5) for k in range(1000)]
