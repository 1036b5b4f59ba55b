"""Cross-fitting by key, stacking and the comparison of contenders."""

import pytest
from pyspark.sql import functions as F

from concordia.operators import contenders as C


@pytest.fixture(scope="module")
def rows(spark):
    keys = [f"K{i:03d}" for i in range(60)]
    data = [(i * 10 + j, k, f"{k}-{j}", int(j == 0), (10 - j + i % 3) / 13, ((i + j) % 5) / 5) for i, k in enumerate(keys) for j in range(4)]
    return spark.createDataFrame(data, "row int, truth string, key string, label int, a double, b double").withColumn("part", C.part_of(F.col("truth"))).cache()


def test_folds_and_parts_go_by_key(rows):
    assert rows.groupBy("truth").agg(F.count_distinct("part").alias("n")).filter("n > 1").count() == 0
    assert {r.part for r in rows.select("part").distinct().collect()} == {"train", "validation", "test"}
    assert rows.select(C.fold_of(F.col("truth")).alias("f")).agg(F.min("f"), F.max("f")).first()[:] == (0, 4)


def test_no_row_is_scored_by_what_it_taught(rows):
    """Labels that only depend on the key can't be learned for keys of another fold, but are by a model that has seen them."""
    flat = rows.withColumn("label", (F.crc32("truth") % 2).cast("int")).withColumn("f", (F.crc32("truth") % 1000).cast("double"))
    out = C.cross_fit(flat, ["a", "b"], "p", "truth")
    assert out.count() == flat.count() and out.filter("p is null or p < 0 or p > 1").count() == 0
    again = {r.row: r.p for r in C.cross_fit(flat, ["a", "b"], "p", "truth").collect()}
    assert {r.row: r.p for r in out.collect()} == pytest.approx(again)
    # a row's own label has no part in its score
    turned = flat.withColumn("label", F.when(C.fold_of(F.col("truth")) == 0, 1 - F.col("label")).otherwise(F.col("label")))
    other = {r.row: r.p for r in C.cross_fit(turned, ["a", "b"], "p", "truth").filter(C.fold_of(F.col("truth")) == 0).collect()}
    assert other == pytest.approx({r: again[r] for r in other})


def test_stack_scores_all_rows(rows):
    out = C.stack(rows, {"m": (["a"], "logreg"), "n": (["a", "b"], "logreg")}, ["b"], "truth")
    assert out.count() == rows.count() and {"m", "n", "stacked"} <= {*out.columns}
    assert out.filter("label = 1").agg(F.avg("stacked")).first()[0] > out.filter("label = 0").agg(F.avg("stacked")).first()[0]


def test_compare_against_a_loop(rows, spark):
    data = rows.select(F.col("truth").alias("case_id"), "part", "key", "label", "a", "b")
    lone = spark.createDataFrame([("lost1", "test"), ("lost2", "test"), ("lost3", "train")], "case_id string, part string")
    reads = data.select("case_id", "part").distinct().unionByName(lone)
    got = {r.contender: r for r in C.compare(data, reads, ["a", "b"], 0.5).collect()}
    plain = data.collect()
    n = len({r.case_id for r in plain if r.part == "test"}) + 2
    for c in ("a", "b"):
        order = lambda part: {k: sorted((r for r in plain if r.part == part and r.case_id == k), key=lambda r: (-r[c], r.key)) for k in {r.case_id for r in plain if r.part == part}}  # noqa: B023, E731
        ranks = [next(i + 1 for i, r in enumerate(v) if r.label) for v in order("test").values()]
        tops = sorted(((v[0][c], v[0].label) for v in order("validation").values()), reverse=True)
        fits = [s for s in {s for s, _ in tops} if (lambda above: sum(above) / len(above) >= 0.5)([g for x, g in tops if x >= s])]
        taken = [v[0].label for v in order("test").values() if fits and v[0][c] >= min(fits)]
        assert got[c].n == n and got[c].top1 == pytest.approx(sum(r == 1 for r in ranks) / n) and got[c].mrr == pytest.approx(sum(1 / r for r in ranks) / n)
        assert got[c].accept_recall == pytest.approx(sum(taken) / n) and got[c].accept_precision == pytest.approx(sum(taken) / len(taken) if taken else 0.0)


def test_unlabelled(spark):
    reads = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "case_id int, truth string")
    assert {r.case_id for r in C.unlabelled(reads, spark.createDataFrame([("A",)], "key string")).collect()} == {2, 3}
