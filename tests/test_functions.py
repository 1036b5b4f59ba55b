import random

import pytest
from pyspark.sql import functions as F

from concordia.functions import similarity as S
from concordia.functions import transforms as T


def pair(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string")


def value(spark, measure, a, b):
    return pair(spark, a, b).select(measure(F.col("a"), F.col("b"))).first()[0]


@pytest.mark.parametrize("a, b, d", [("David Smiths", "Davidd Simth", 4), ("dva", "dave", 2), ("Vishwanathan", "Vishvnahtan", 4)])
def test_levenshtein(spark, a, b, d):
    assert value(spark, S.levenshtein, a, b) == d


@pytest.mark.parametrize("a, b, v", [("jon", "john", 0.917), ("jon", "ojhn", 0.8056), ("Vishwanathan", "Vishvnahtan", 0.847), ("ABCDEF", "BCADEF", 0.9167)])
def test_jaro(spark, a, b, v):
    assert value(spark, S.jaro, a, b) == pytest.approx(v, abs=1e-3)


def test_other_measures(spark):
    assert value(spark, S.jaro_winkler, "Vishwanathan", "Vishvnahtan") == pytest.approx(0.9082, abs=1e-3)
    assert value(spark, S.overlap_count, "dave", "dav") == 3
    assert value(spark, S.jaccard, "dave", "dav") == 0.5
    assert value(spark, S.ratcliff, "MATHEMATICS", "MATEMATICA") == pytest.approx(0.857, abs=1e-3)
    assert value(spark, S.weighted_edit, "DL01AB1234", "DLO1AB1234") == pytest.approx(0.98)
    codes = spark.createDataFrame([("Banarjee",), ("Benerji",), ("Pfister",), ("",)], "a string").select(S.soundex_code(F.col("a"))).collect()
    assert [r[0] for r in codes] == ["B562", "B562", "P123", ""]


@pytest.mark.parametrize("name", S.MEASURES)
def test_measures_are_similarities(spark, name):
    r = random.Random(1)
    texts = [None, "", *("".join(r.choice("ABcd01") for _ in range(r.randint(1, 8))) for _ in range(12))]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    m = S.MEASURES[name]
    for row in df.select("a", "b", m(F.col("a"), F.col("b")).alias("x"), m(F.col("b"), F.col("a")).alias("y"), m(F.col("a"), F.col("a")).alias("same")).collect():
        assert 0 <= row.x <= 1 and row.same == 1
        if name != "ratcliff":
            assert row.x == pytest.approx(row.y)
        if bool(row.a) != bool(row.b):
            assert row.x == 0


def test_transforms(spark):
    df = spark.createDataFrame([("dl-01 ab.1234", "1/9/2026", "1739232000", "o'neil mary-jane 3rd", " hundai ", "susp")], "p string, d string, e string, t string, m string, s string")
    r = df.select(T.norm_plate(F.col("p")), T.parse_ddmmyyyy(F.col("d")).cast("string"), T.epoch_to_date(F.col("e")).cast("string"), T.title_case(F.col("t")), T.fix_make(F.col("m")), T.status_map(F.col("s")), T.epoch_to_date(F.col("p")), T.transform("no such")(F.col("p"))).first()
    assert list(r) == ["DL01AB1234", "2026-09-01", "2025-02-11", "O'Neil Mary-Jane 3Rd", "Hyundai", "SUSPENDED", None, "dl-01 ab.1234"]


def test_times(spark):
    rows = [("1739232000", "epoch"), ("2026-01-02T03:04:05+05:30", "iso"), ("02/01/2026 03:04:05", "%d/%m/%Y %H:%M:%S"), ("02-01-2026 03:04", "%d-%m-%Y %H:%M"), ("2026/01/02 03:04:05", "%Y/%m/%d %H:%M:%S"), ("soon", None), (None, None), ("12345", None)]
    got = spark.createDataFrame(rows, "t string, f string").select("f", T.parse_ts(F.col("t")).alias("p")).collect()
    assert [r.p.format for r in got] == [f for _, f in rows]
    assert str(got[1].p.moment) == "2026-01-02 03:04:05"


def test_keys(spark):
    r = spark.createDataFrame([("DL01AB1234",)], "p string").select(T.render_plate(F.col("p"), separator="-"), T.render_plate(F.col("p"), separator=" ", lower=True), T.mask_plate(F.col("p")), T.shape(F.col("p")), T.pattern(F.col("p"), ["DL"]), T.pattern(F.col("p"), ["HR"])).first()
    assert list(r) == ["DL-01-AB-1234", "dl 01 ab 1234", "DL******34", "LLDDLLDDDD", "S^+^", "+^+^"]
    with pytest.raises(Exception, match="empty key"):
        spark.createDataFrame([("--",)], "p string").select(T.canonical_plate(F.col("p"))).collect()


def test_what_a_form_keeps_from_the_parsers_they_refuse(spark):
    texts = ["1/2/2000", "01/02/2000 3:4", "1/2/2000 03:04:05", "1-2-2000 3:4", "1-2-2000 3:4:5", "2000/1/2 3:4:5", "2000-1-2", "2000-1-2 3:4", "+2000/1/2 3:4:5", "-1/2/2000", "12/-3/2000", "1/2/20000", "31/2/2000", "1/2/2000 ", " 1/2/2000", "1/2/2000\n", "1 / 2/2000", "1/2", "a/b/c", "", "2000-1-2x", "١/2/2000", None]
    c = F.col("t")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.select(T.parse_ddmmyyyy(c)).collect() == df.select(F.coalesce(F.try_to_date(c, "d/M/yyyy"), F.try_to_date(c, "yyyy-M-d"))).collect()
    got = [r.p for r in df.select(T.parse_ts(c).alias("p")).collect()]
    for name, form in T.TIME_FORMATS.items():
        plain = [r[0] for r in df.select(F.try_to_timestamp(F.trim(c), F.lit(form)).cast("timestamp_ntz")).collect()]
        assert all(g.format for g, p in zip(got, plain) if p) and all(g.moment == p for g, p in zip(got, plain) if g.format == name)
    assert df.select(T.parse_ddmmyyyy(F.lit("2000-01-02 03:04:05").cast("timestamp")).cast("string")).first()[0] == "2000-01-02"


def test_measures_of_many_pairs_together(monkeypatch):
    """Exactly those of each pair by itself, which they don't fall back to."""
    import random

    r = random.Random(3)
    for m, n in ((1, 1), (1, 9), (10, 10), (10, 9), (4, 12)):
        xs, ys = (["".join(r.choice("01OIDB8é𝄞") for _ in range(k)) for _ in range(60)] for k in (m, n))
        ys[:5] = xs[:5] if m == n else ys[:5]
        want = [S.weighted_distance(x, y, S.confusion_cost) for x, y in zip(xs, ys)], [S._jaro(x, y) for x, y in zip(xs, ys)]
        with monkeypatch.context() as only:
            only.setattr(S, "weighted_distance", None)
            only.setattr(S, "_jaro", None)
            assert (S.weighted_distances(xs, ys, S.confusion_cost).tolist(), S.jaros(xs, ys).tolist()) == want
    assert S.jaros(["AB"], ["BA"]).tolist() == [S._jaro("AB", "BA")]
