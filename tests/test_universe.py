"""Keys of all sources with who holds them; candidates of each way of finding them; boxes; suggestions; sums that hold at any size."""

import math

import pytest
from pyspark.sql import functions as F

from concordia.functions import boxes
from concordia.operators import blocking, cleansing, evaluate, matching, retrieval, universe
from concordia.plans import mediate


def test_universe(spark):
    reg = spark.createDataFrame([("DL01AB0001", "Kia", "Rio", " "), ("DL01AB0002", None, "", None), (None, "x", "y", "z")], "key string, make string, model string, colour string")
    ins = spark.createDataFrame([("DL01AB0001",), ("DL01AB0001",), ("DL01AB0003",), ("",)], "key string")
    seen = [
        ("DL01AB0002", "2026-01-02", "b", 0.9, "kia", "Rio", "red"), ("DL01AB0002", "2026-01-01", "a", 0.6, "KIA", "Figo", ""), ("DL01AB0002", None, "c", 0.59, "Tata", "Rio", "Red"), ("DL01AB0002", "2026-01-02", "a", None, "Tata", None, None),
        ("DL01AB0004", "2026-01-01", None, 0.9, "Tata", "x", "Blue"), ("DL01AB0004", "2026-01-01", None, 0.9, "Kia", "x", None), ("DLO1AB0004", "2026-01-01", "a", 0.9, "Tata", None, None), (None, "2026-01-01", "a", 0.9, "Tata", None, None),
    ]
    cam = spark.createDataFrame(seen, "key string, seen_at string, seen_where string, ocr_confidence double, observed_make string, observed_model string, observed_colour string")
    got = {r.key: r for r in universe.universe({"INS": ins, "REG": reg}, cam, "REG").collect()}
    assert sorted(got) == ["DL01AB0001", "DL01AB0002", "DL01AB0003", "DL01AB0004"]
    a, b, c, d = (got[k] for k in sorted(got))
    assert (a.sources, a.registered, a.prior, a.make, a.colour, a.sightings, a.held_by) == (["REG", "INS"], True, 1.0, "Kia", None, 0, "REG, INS")
    assert (b.sources, b.make, b.model, b.colour, b.fingerprint, b.sightings, b.seen_at, b.seen_where) == (["REG", "CAM"], "Kia", None, "Red", ["make", "colour"], 4, "2026-01-02", "b")
    assert (c.sources, c.registered, c.prior, c.held_by) == (["INS"], False, 1.0, "not registered; known to INS")
    assert (d.sources, d.prior, d.make, d.model, d.colour, d.fingerprint, d.held_by) == (["CAM"], 0.3, None, "X", "Blue", ["model", "colour"], "not registered; known to CAM")
    assert universe.universe({"REG": reg.filter("false")}, cam.filter("false"), "REG").count() == 0
    with pytest.raises(ValueError):
        universe.universe({"INS": ins}, cam, "REG")


def test_retrieval(spark):
    keys = spark.createDataFrame([("DL01AB1234",), ("DL01AB1239",), ("HR26EF4455",)], "key string")
    rows = [("DL01AB1234", "DL01AB1234", "validation"), ("DL01AB1234", "DL01AB1234", "validation"), ("DLO1AB1Z34", "DL01AB1234", "validation"), ("", "HR26EF4455", "test"), (None, "HR26EF4455", "test"), ("HR26EF4455", "UP16GH1122", "test")]
    reads = spark.createDataFrame(rows, "read string, truth string, part string")
    table = retrieval.retrieval(reads, keys, edits=(1, 2, 3)).cache()
    got = {(r.strategy, r.edits, r.part): r for r in table.collect()}
    assert len(got) == 14 and got["none", 0, "validation"].recall == 1.0 and got["none", 0, "validation"].mean_candidates == 3.0
    assert (got["none", 0, "test"].n, got["none", 0, "test"].recall, got["none", 0, "test"].mean_candidates) == (3, 0.0, 1.0)
    for s in ("prefix", "position"):
        assert got[s, 1, "validation"].recall == pytest.approx(2 / 3) and got[s, 2, "validation"].recall == 1.0 and got[s, 1, "test"].recall == 0.0
    with pytest.raises(ValueError):
        retrieval.retrieval(reads, keys, strategies=("index",))
    # what is counted once is what each strategy finds by itself
    for s in retrieval.EXACT:
        for k in (1, 2, 3):
            n = blocking.candidates(reads.filter("part = 'validation'"), "read", keys, "key", s, k).groupBy("read").count()
            n = {r.read: r["count"] for r in n.collect()}
            assert got["position", k, "validation"].mean_candidates == pytest.approx((2 * n.get("DL01AB1234", 0) + n.get("DLO1AB1Z34", 0)) / 3)
    assert retrieval.choose_edits(table).first()[:] == (2, True)
    assert retrieval.choose_edits(table.filter("edits < 2")).first()[:] == (1, False)
    assert retrieval.choose_edits(table, slack=0.5, wanted=1.1).first()[:] == (1, False)


def test_boxes(spark):
    corner = "struct<x:double,y:double>"
    texts = [("i", "DL 01 AB", 0.5, 10, 10, 60, 30), ("i", "1234", 0.9, 12, 32, 58, 50), ("i", "IND", 0.9, 0, 10, 8, 30), ("i", "TAXI", 0.9, 300, 300, 340, 320), ("j", "HR26EF4455", 0.1, 0, 0, 70, 20), ("j", "VERYLONGADVERTISING", 0.9, 0, 200, 500, 260), ("k", "IND", 0.9, 0, 0, 5, 5), (None, "x", None, 0, 0, 1, 1)]
    rows = [(i, t, c, [(float(x), float(y)), (float(u), float(y)), (float(u), float(v)), (float(x), float(v))]) for i, t, c, x, y, u, v in texts]
    df = spark.createDataFrame([*rows, ("i", "blank", 0.2, None)], f"image_id string, text string, confidence double, corners array<{corner}>")
    kept = boxes.plate_lines(df)
    assert sorted((str(r.image_id), r.text) for r in kept.collect()) == [("None", "x"), ("i", "1234"), ("i", "DL 01 AB"), ("j", "HR26EF4455"), ("k", "IND")]
    whole = kept.groupBy("image_id").agg(boxes.union(F.collect_list("box")).alias("box")).filter("image_id = 'i'")
    assert tuple(whole.first().box) == (10.0, 10.0, 60.0, 50.0)
    size = lambda w, h: (F.lit(w), F.lit(h))
    f = whole.select(boxes.fractions(F.col("box"), *size(100, 100)).alias("f"), boxes.is_closeup(F.col("box"), *size(100, 100)).alias("near"), boxes.is_closeup(F.col("box"), *size(1000, 1000)).alias("far")).first()
    assert (f.f.area, f.f.width, f.near, f.far) == (0.2, 0.5, True, False)
    none = spark.range(1).select(boxes.fractions(boxes.bounds(F.array().cast(f"array<{corner}>")), *size(0, 0)).alias("f"), boxes.union(F.array().cast("array<struct<left:double,top:double,right:double,bottom:double>>")).alias("u")).first()
    assert tuple(none.f) == (0.0, 0.0) and none.u is None


def test_suggestions(spark):
    cases = [
        ([], [], None), (None, [], None), (["LOW_OCR_CONFIDENCE", "IMPOSSIBLE_TRAVEL"], [], "confirm_clone"), (["MAKE_DISAGREES_REGISTRATION", "PLATE_NOT_REGISTERED"], [], "confirm_clone"),
        (["PLATE_NOT_REGISTERED"], [("K", "REJECT", 0.1), ("L", "REVIEW", 0.6)], "accept_candidate"), (["PLATE_NOT_REGISTERED"], [("K", "ACCEPT", 0.99)], "accept_candidate"), (["PLATE_NOT_REGISTERED"], None, "dismiss"),
        (["PLATE_NOT_REGISTERED", "PLATE_SHAPE_INVALID"], [("K", "REJECT", 0.1)], "dismiss"), (["PLATE_SHAPE_INVALID"], [], "delete_record"), (["DUPLICATE_CAPTURE", "TIMESTAMP_FUTURE"], [], "delete_record"),
        (["TIMESTAMP_UNPARSEABLE"], [], "delete_record"), (["LOW_OCR_CONFIDENCE"], [], "dismiss"), (["TIMESTAMP_NONSTANDARD"], [], "dismiss"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, codes array<string>, c array<struct<key:string,decision:string,p:double>>")
    got = {r.i: r.s for r in df.select("i", cleansing.suggest(F.col("codes"), F.col("c")).alias("s")).collect()}
    assert [s and s.decision for _, s in sorted(got.items())] == [c[2] for c in cases]
    assert "L (p=0.600)" in got[4].reason and "K (p=0.990)" in got[5].reason and "K" in got[7].reason


def test_names_of_rules(spark):
    df = spark.createDataFrame([("UNINSURED — WARNING",), ("UNREGISTERED / SUSPICIOUS",), ("SUSPICIOUS — POSSIBLE CLONED PLATE",), ("else",), (None,)], "d string")
    assert [r[0].split(":")[0] for r in df.select(mediate.rule_fired(F.col("d"))).collect()] == ["Rule 5b", "Rule 3", "Rule 4", "Unmapped decision rule", "Unmapped decision rule"]


def test_rule_match_agrees_with_resolution(spark):
    keys = spark.createDataFrame([("DL01AB1234", "Kia", "Red"), ("DLO1AB1234", "Tata", "Blue"), ("DL01AB0000", "Kia", "Red")], "key string, make string, colour string")
    reads = spark.createDataFrame([(1, "DLO1AB1234", "Kia", "Red"), (2, "DLO1AB1234", None, None), (3, "QQ", None, None), (4, None, None, None)], "case_id int, read string, observed_make string, observed_colour string")
    got = {(r.case_id, r.rank): (r.key, r.decision) for r in matching.rule_match(reads, keys).collect()}
    assert got == {(1, 1): ("DL01AB1234", "ACCEPT"), (1, 2): ("DLO1AB1234", "REVIEW"), (2, 1): ("DLO1AB1234", "ACCEPT"), (2, 2): ("DL01AB1234", "REVIEW"), (3, 1): (None, "REJECT"), (4, 1): (None, "REJECT")}
    best = {r.case_id: (r.resolved, r.outcome) for r in matching.resolve(reads, keys).collect()}
    assert {c: k for (c, n), (k, _) in got.items() if n == 1} == {c: k for c, (k, _) in best.items()}


def test_mcnemar_of_large_counts(spark):
    def p(b, c):
        rows = spark.range(b).selectExpr("0 AS a", "1 AS b").union(spark.range(c).selectExpr("1 AS a", "0 AS b"))
        return evaluate.mcnemar(rows, "a", "b").first().p_value

    exact = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))
    for b, c in ((0, 0), (3, 0), (5, 9), (40, 60), (900, 1000), (5000, 5200)):
        assert p(b, c) == pytest.approx(exact(b, c), rel=1e-9)
    assert p(1_000_000, 1_002_000) == pytest.approx(2 * 0.5 * math.erfc((2000 - 1) / math.sqrt(2_002_000) / math.sqrt(2)), rel=1e-3)


def test_running_totals_with_far_values(spark):
    values = [0.0, 1e300, -5.0, *((i * i) % 97 + i / 7 for i in range(500))]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    runs = {r.v: r.run_n for r in evaluate._running(df.filter("v is not null").groupBy("v").agg(F.count("*").alias("n")), "v", ["n"], False).collect()}
    assert runs == {v: sum(w <= v for w in values) for v in values}
    s = sorted(values)
    got = evaluate.percentiles(df, "v", (0.0, 0.5, 0.95)).first()
    assert got[0] == s[0] and got[1] == pytest.approx(s[len(s) // 2])


def test_abbreviations_meet_words_by_three_signs(spark):
    words = ["Maruti", "Mahindra", "Mercedes", "Mini", "Honda", "Hyundai", "Aaaa", "Abc"]
    tried = ["mrt", "mhd", "mrc", "mni", "hnd", "hyn", "aaa", "mrcds", "mhdra", "ac", "xyz", "mia"]
    key = cleansing.mine(spark.createDataFrame([(w,) for w in words * 2], "w string"), "w").select("key", "canonical")
    assert key.count() == len(words)

    def within(a, b):
        it = iter(b.lower())
        return all(c in it for c in a.lower())

    got = {r.v: r.canonical for r in cleansing.lookup(spark.createDataFrame([(t,) for t in tried], "v string"), "v", key).filter("kind = 'abbreviation'").collect()}
    want = {}
    for t in tried:
        own = [w for w in words if len(t) >= 3 and w[0].lower() == t[0] and len(t) < len(w) and within(t, w)]
        if len(own) == 1 and not any(w.lower().startswith(t) for w in words):
            want[t] = own[0]
    assert got == want and got
