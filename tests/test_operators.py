import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from concordia.operators import adjudicate, blocking, cleansing, evaluate, matching, open_world, rules, schema_match


def plates(n, seed=3):
    r = random.Random(seed)
    return sorted({f"{r.choice(['DL', 'HR', 'UP'])}{r.randint(1, 30):02d}{r.choice('ABCDEFGH')}{r.choice('JKLMN')}{r.randint(0, 9999):04d}" for _ in range(n)})


@pytest.mark.parametrize("strategy", blocking.STRATEGIES)
def test_no_single_misread_is_lost(spark, strategy):
    r, known = random.Random(5), plates(80)
    swap = {"0": "O", "1": "I", "8": "B", "5": "S", "2": "Z", "6": "G"}
    reads = []
    for p in known:
        at = [i for i, c in enumerate(p) if c in swap]
        if at:
            i = r.choice(at)
            reads.append((p[:i] + swap[p[i]] + p[i + 1 :], p))
    found = blocking.candidates(spark.createDataFrame(reads, "read string, key string"), "read", spark.createDataFrame([(p,) for p in known], "key string"), "key", strategy, edits=1)
    assert {(a, b) for a, b in reads} <= {(x.read, x.key) for x in found.collect()}


def test_strategies_agree_and_two_edits_need_two(spark):
    known = spark.createDataFrame([(p,) for p in [*plates(60), "DL01AB1234"]], "key string")
    read = spark.createDataFrame([("DLO1AB1Z34",), ("",), (None,)], "read string")
    got = {s: {(x.read, x.key) for x in blocking.candidates(read, "read", known, "key", s, edits=2).collect()} for s in ("size", "prefix", "position")}
    assert got["size"] == got["prefix"] == got["position"] and ("DLO1AB1Z34", "DL01AB1234") in got["size"]
    assert ("DLO1AB1Z34", "DL01AB1234") not in {(x.read, x.key) for x in blocking.candidates(read, "read", known, "key", "position", edits=1).collect()}
    assert ("DLO1AB1Z34", "DL01AB1234") in {(x.read, x.key) for x in blocking.retrieve(read, "read", known, "key", edits=1).collect()}


def test_sql_prefilter():
    p = blocking.sql_prefilter("dl-01-ab-1234", "t.c")
    assert "LIKE 'DL%'" in p and "BETWEEN 9 AND 11" in p
    assert blocking.sql_prefilter("", "c") == blocking.sql_prefilter("D", "c") == "1=1"
    with pytest.raises(ValueError):
        blocking.sql_prefilter("DL01", "c; drop")


def test_variants_and_deletes(spark):
    r = spark.createDataFrame([("D0",)], "k string").select(blocking.variants(F.col("k")), blocking.deletes(F.col("k"))).first()
    assert r[0] == ["D0", "00", "O0", "DO", "DD"] and sorted(r[1]) == ["0", "D", "D0"]


def test_verdicts(spark):
    rows = [("a", "k1", 0.95, 1, 0.5, 1.0, 1.0, 0.0, 0.1), ("b", "k1", 0.95, 1, 0.9, 1.0, 1.0, 0.0, 0.1), ("c", "k1", 0.95, 1, 0.0, -1.0, 0.0, -1.0, 0.1), ("d", "k1", 0.95, 1, 0.0, 1.0, 1.0, 1.0, 0.7), ("e", "k1", 0.4, 1, 0.0, 0.0, 0.0, 0.0, 0.0), ("f", "k1", 0.95, 2, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "read string, key string, p double, rank int, runner_up double, make_agree double, model_agree double, colour_agree double, p_unknown double")
    assert [r.decision for r in matching.verdict(df).orderBy("read").collect()] == ["ACCEPT", "REVIEW", "REVIEW", "REVIEW", "REJECT", "REVIEW"]


def _plain_likelihood(read, slots, eps, indel):
    """All alignments, cell by cell; slots: the characters that each may be, and all of them are summed."""
    def seen(r, c):
        if r == c:
            return 1 - eps
        others = matching.S.CONFUSABLE.get(r, "")
        return eps * 0.3 / 35 + (eps * 0.7 / len(others) if c in others else 0)

    def fill(row):
        for j in range(1, len(row)):
            row[j] += row[j - 1] * indel / 36
        return row

    state = fill([1.0] + [0.0] * len(read))
    for chars in slots:
        state = fill([f * indel * len(chars) + (state[j - 1] * sum(seen(read[j - 1], c) for c in chars) if j else 0) for j, f in enumerate(state)])
    return state[-1]


@pytest.mark.parametrize("confidence", [0.95, 0.5, None])
def test_open_world_against_all_alignments(confidence):
    eps, indel = open_world.rates(confidence)
    reads = ["DL01AB1234", "DLO1AB1Z34", "D", "21BH1234AA", "QQ?1", "DL01AB12345"]
    for plate in ("DL01AB1234", "HR26E4455"):
        want = [_plain_likelihood(r, list(plate), eps, indel) for r in reads]
        assert open_world.likelihoods(reads, [plate] * len(reads), [confidence] * len(reads)).tolist() == pytest.approx(want)
    letters, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    sets = {"L": letters, "D": digits}
    want = []
    for r in reads:
        civil = sum(_plain_likelihood(r, [*state, digits, digits, *[letters] * k, *[digits] * 4], eps, indel) for state in open_world.STATES for k in (1, 2, 3))
        want.append(civil + sum(_plain_likelihood(r, [sets.get(c, c) if c != "B" and c != "H" else c for c in shape], eps, indel) for shape in open_world.SHAPES[3:]))
    assert open_world.masses(reads, [confidence] * len(reads)).tolist() == pytest.approx(want)
    assert open_world.masses([""], [confidence])[0] == 0 and open_world.masses(["A"], [0.9], {})[0] == 0


def test_open_world(spark):
    df = spark.createDataFrame([("DL01AB1234", "DL01AB1234", 0.95), ("DL01AB1299", "DL01AB1234", None)], "read string, key string, ocr_confidence double")
    p = {r.read: r.p_unknown for r in open_world.open_world(df).collect()}
    assert p["DL01AB1234"] < 0.05 < 0.5 < p["DL01AB1299"]
    plates = spark.createDataFrame([("DL01AB1234",), ("XX01AB1234",), ("21BH1234AA",), ("DL01A1234",), (None,), ("",)], "p string")
    assert [r[0] for r in plates.select(open_world.is_valid(F.col("p"))).collect()] == [True, False, True, True, False, False]
    w = open_world.shape_weights(plates, "p")
    assert sum(w.values()) == pytest.approx(len(open_world.SHAPES)) and w["SDDLLDDDD"] == w["SDDLDDDD"] > w["SDDLLLDDDD"]


def test_every_capture_is_matched(spark):
    known = spark.createDataFrame([("DL01AB1234", "Kia", "Red", 3), ("DL01AB1234", "Kia", "Red", 3), ("HR26EF4455", "Tata", "Blue", 1), ("DL05CD9876", "Kia", "Grey", 2)], "key string, make string, colour string, sources int")
    rows = [(1, "DL01AB1234", "KIA", "Red", 0.95), (2, "DL01AB1234", "TATA", "Blue", 0.95), (3, "DLO1AB1234", "Kia", "Red", 0.95), (4, "", "Kia", "Red", 0.9), (5, None, None, None, None), (6, "ZZZZ", "Kia", "Red", 0.9), (7, "DL09QQ9009", None, None, 0.95), (8, "OL05CD9876", "Kia", "Grey", 0.95), (9, "OL05CD9876", "Kia", None, 0.95)]
    captures = spark.createDataFrame(rows, "case_id int, read string, observed_make string, observed_colour string, ocr_confidence double")
    got = {r.case_id: r for r in matching.explain(matching.match(captures, known)).filter("rank = 1").collect()}
    assert sorted(got) == list(range(1, 10))
    assert got[1].decision == "ACCEPT" and got[2].decision == "REVIEW" and "what was seen contradicts the record" in got[2].why
    assert got[1].key == got[2].key == got[3].key == "DL01AB1234" and got[8].key == "DL05CD9876"
    assert {got[i].decision for i in (4, 5)} == {"REJECT"} and got[4].key is None and got[7].decision != "ACCEPT"
    assert got[8].state_fix and got[9].decision != "ACCEPT"
    assert 0.9 < got[1].tfidf <= 1.0 and got[3].tfidf < got[1].tfidf


def test_learned_costs_reach_the_matcher(spark):
    known = spark.createDataFrame([("DL01AB1234",)], "key string")
    reads = spark.createDataFrame([(1, "DL01AB1Q34")], "case_id int, read string")
    plain, learned = (matching.match(reads, known, costs=c).first() for c in (None, {("2", "Q"): 0.1}))
    assert learned.learned > plain.learned == plain.ocr_edit and learned.p > plain.p


def test_readings(spark):
    get = lambda k, **o: spark.createDataFrame([(k,)], "k string").select(blocking.readings(F.col("k"), **o)).first()[0]
    assert get("1B") == ["1B", "IB", "18", "I8"]
    assert len(get("0000000000")) == 64 and len(set(get("0000000000", limit=512))) == 512 and get("XY") == ["XY"] and get("") == [""]
    assert "01" in get("OI") and get("OI")[0] == "OI"
    with pytest.raises(ValueError):
        blocking.readings(F.col("k"), limit=513)


def test_two_deletions_find_two_edits(spark):
    known = spark.createDataFrame([("DL01AB1234",), ("HR26EF4455",)], "key string")
    reads = spark.createDataFrame([("DLO1AB1Z34",), ("DL1AB1234",), ("XX",)], "read string")
    assert {(r.read, r.key) for r in blocking.by_deletes(reads, "read", known, "key", 2).collect()} == {("DLO1AB1Z34", "DL01AB1234"), ("DL1AB1234", "DL01AB1234")}


def test_exact_tests_and_percentiles(spark):
    from math import comb

    for b01, b10 in ((0, 0), (1, 0), (7, 2), (40, 61), (300, 250)):
        rows = [(0, 1)] * b01 + [(1, 0)] * b10 + [(1, 1)] * 3
        got = evaluate.mcnemar(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
        n = b01 + b10
        assert (got.b01, got.b10) == (b01, b10) and got.p_value == pytest.approx(min(1.0, 2 * sum(comb(n, i) for i in range(min(b01, b10) + 1)) / 2**n))
    values = [3.0, 1.0, 1.0, 2.0, 1e9, None, -5.0]
    got = evaluate.percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", (0.0, 0.5, 0.9, 1.0)).first()
    assert list(got) == pytest.approx([-5.0, 1.5, 500000001.5, 1e9])
    assert evaluate.percentiles(spark.createDataFrame([], "v double"), "v").first().p50 is None


def test_resolve(spark):
    known = spark.createDataFrame([("DL01AB1234", "Maruti Suzuki", "Red"), ("DLO1AB9999", "Kia", "Blue"), ("DL01AB9999", "Kia", "Blue")], "key string, make string, colour string")
    reads = spark.createDataFrame([(1, "DLO1AB1234", "Maruti", None), (2, "DL01AB9999", None, None), (3, "XX99XX9999", "Kia", "Blue")], "case_id int, read string, observed_make string, observed_colour string")
    assert {r.case_id: r.outcome for r in matching.resolve(reads, known).collect()} == {1: "RESOLVED", 2: "RESOLVED", 3: "NONE"}


def test_trained_models_separate(spark):
    rows = [(float(i % 10) / 10, float(i % 7), int(i % 10 > 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    out = matching.train(df, ["a", "b"]).transform(df.withColumn("label", F.col("label").cast("double")))
    assert out.filter("prediction = label").count() > 190
    slope, _ = matching.fit_platt(df.withColumnRenamed("a", "score"))
    assert slope > 0


def test_rule_tree(spark):
    tree = rules.Tree({"id": "a", "condition": {"true": True}, "conclusion": {"action": "keep"}, "except": {"id": "b", "condition": {"field": "x", "op": "gt", "value": 5}, "conclusion": {"action": "set", "value": "$y"}, "except": {"id": "c", "condition": {"field": "y", "op": "is_null"}, "conclusion": {"action": "flag"}}, "else": {"id": "d", "condition": {"not": {"field": "x", "op": "eq", "value": 1}}, "conclusion": {"action": "drop"}}}})
    df = spark.createDataFrame([(9, "v"), (9, None), (1, "v"), (None, "v"), (2, "v")], "x int, y string")
    assert [(r.rule, r.action, r.set_to) for r in tree.infer(df).collect()] == [("b", "set", "v"), ("c", "flag", None), ("a", "keep", None), ("d", "drop", None), ("d", "drop", None)]
    cases = spark.createDataFrame([(9, "v", "b")], "x int, y string, rule string")
    bad = {"id": "n", "condition": {"field": "y", "op": "eq", "value": "v"}, "conclusion": {"action": "keep"}}
    with pytest.raises(ValueError, match="cornerstone"):
        tree.add_exception(spark, "b", bad, cases)
    good = tree.add_exception(spark, "b", {**bad, "condition": {"field": "y", "op": "eq", "value": "w"}}, cases)
    assert good.infer(spark.createDataFrame([(9, "w")], "x int, y string")).first().rule == "n"


def test_missing_values_compare_false(spark):
    df = spark.createDataFrame([(None, "r")], "a string, r string")
    ask = lambda c: df.select(rules.holds(c)).first()[0]
    leaf = lambda op, v=None: {"field": "a", "op": op, "value": v}
    assert not any(ask(leaf(op, v)) for op, v in (("ne", "x"), ("not_in", ["x"]), ("eq", "x"), ("lt", 3), ("contains_digit", None), ("is_true", None)))
    assert ask({"not": leaf("eq", "x")}) and ask(leaf("is_null")) and ask({"field": "r", "op": "ne", "value": "$a"})


def test_lexicon(spark):
    reg = spark.createDataFrame([(c,) for c in ["Grey"] * 4 + ["GREY"] + ["Maroon", "Silver", "Silver", "i20", "i20", "Maroon"]], "c string")
    lex = cleansing.mine(reg, "c")
    assert {(r.canonical, r.support) for r in lex.collect()} == {("Grey", 5), ("Maroon", 2), ("Silver", 2), ("i20", 2)}
    values = [("Grey", "exact"), ("grey", "surface"), ("Gray", "edit"), ("Gry", "abbreviation"), ("Mar", "prefix"), ("i10", None), ("zzzz", None), ("crimson", "alias")]
    alias = spark.createDataFrame([("crimson", "Maroon")], "alias string, canonical string")
    got = cleansing.lookup(spark.createDataFrame(values, "v string, k string"), "v", lex, alias)
    assert {r.v: r.kind for r in got.collect()} == dict(values)


def test_travel_and_duplicates(spark):
    at = dt.datetime(2026, 1, 1, 10)
    rows = [("p", 1, at, 28.6, 77.2), ("p", 2, at + dt.timedelta(minutes=30), 26.9, 75.8), ("p", 3, at + dt.timedelta(hours=9), 28.6, 77.2), ("q", 4, at, 0.0, 0.0), ("p", 5, at, 28.6, 77.2)]
    df = spark.createDataFrame(rows, "plate string, id long, at timestamp_ntz, lat double, lon double")
    got = {r.id: r for r in cleansing.legs(df, "plate", "at", "id").collect()}
    assert set(got) == {2, 3, 5} and got[2].impossible and not got[3].impossible and got[5].kmh is None
    assert {r.id: r.duplicate_of for r in cleansing.duplicates(df, ["plate", "at"], "id").collect() if r.duplicate_of} == {5: 1}


def test_cases(spark):
    events = [(1, 1, "NEW"), (1, 2, "ISSUE"), (1, 3, "DISPUTE_CANCELLED"), (2, 1, "NEW"), (2, 2, "DISPUTE_UPHELD"), (3, 1, "NEW"), (3, 2, "ISSUE"), (3, 3, "DISPUTE_UPHELD"), (3, 4, "HOLD")]
    got = adjudicate.fold(spark.createDataFrame(events, "case_id int, seq int, event string")).collect()
    assert {r.case_id: r.status for r in got} == {1: "CANCELLED", 2: "CANDIDATE", 3: "HOLD"}


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.8), (0, 1, 0.3), (0, 0, 0.1)], "guess int, good int, p double")
    assert list(evaluate.ratios(df, "guess", "good").first())[3:] == [0.5, 0.5, 0.5]
    assert evaluate.threshold(df, "p", "good", 0.6).first()[0] == 0.3
    costs = evaluate.learned_costs(evaluate.confusions(spark.createDataFrame([("A0", "AO"), ("B0", "BO"), ("A1", "AI")], "t string, r string"), "t", "r")).collect()
    assert {(r.a, r.b): (r.n, round(r.cost, 3)) for r in costs} == {("0", "O"): (2, 0.1), ("1", "I"): (1, 0.369)}


def test_schema_matching(spark):
    df = spark.createDataFrame([("DL01AB1234", "Red", "04/09/2024"), ("HR26EF4455", "Blue", "13/11/2026")], "vehicle_reg string, colour string, policy_until string")
    got = schema_match.match(df, "POLICY", {"plate_number": "string", "vehicle_colour": "string", "insurance_expiry": "date", "insurance_start": "date"})
    assert [(c, a) for c, a, _ in got] == [("vehicle_reg", "plate_number"), ("colour", "vehicle_colour"), ("policy_until", "insurance_expiry")]


def test_value_shares_of_many_columns(spark):
    """Each test stands once in the plan: a wide table's plan is no longer than a narrow one's, but for the columns themselves."""
    kinds = {"plate_number": "string", "vehicle_colour": "string", "insurance_expiry": "date"}
    rows = [("DL01AB1234", "Red", "04/09/2024", 1), (None, "red ", "no date", 2), ("x", "Blue", "2024-09-04", None), ("HR26EF4455", None, None, 4)]
    df = spark.createDataFrame(rows, "reg string, `a.b` string, until string, n int")
    got = schema_match.value_shares(df, kinds)
    assert got == {(c, a): {("reg", "plate_number"): 0.5, ("a.b", "vehicle_colour"): 0.75, ("until", "insurance_expiry"): 0.5}.get((c, a), 0.0) for c in df.columns for a in kinds}
    assert set(schema_match.value_shares(df.filter("false"), kinds).values()) == {0.0} and schema_match.value_shares(df, {"owner_name": "string"}) == {}
    sizes, own = [], type(df).groupBy
    for n in (2, 12):
        wide = df.select(*(F.col("until").alias(f"c{i}") for i in range(n)))
        plans = []
        try:
            type(df).groupBy = lambda self, *by: plans.append(self) or own(self, *by)
            schema_match.value_shares(wide, kinds)
        finally:
            type(df).groupBy = own
        sizes.append(len(plans))
    assert sizes == [1, 1]


def test_repaired_reads(spark):
    get = lambda r: spark.createDataFrame([(r,)], "r string").select(blocking.repaired(F.col("r"))).first()[0]
    assert get("DLO1AB1234")[:2] == ["DL01AB1234", "DLO1AB1234"] and get("DL01AB1234") == ["DL01AB1234"]
    assert get("0L01AB1234")[0] == "OL01AB1234" and get("dl-o1-ab-i2s4")[0] == "DL01AB1254" and get("DL01A8123B")[0] == "DL01AB1238"
    assert get(None) == get("") == get(" -") == [] and get("OIB") == ["OIB"] and get("OIBSZGOIBSZGO") == ["OIBSZGOIBSZGO"]
    many = get("018OISZG0IBS")
    assert len(many) == 16 and len(set(many)) == 16
