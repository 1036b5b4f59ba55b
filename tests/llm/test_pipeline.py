import random

import numpy as np

import corpus_pipeline as cp
from concordia.llm import simhash

from . import brute


def shingles(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def near(a, b):
    s, t = shingles(a), shingles(b)
    return len(s & t) >= 0.8 * len(s | t)


def test_near_copies(spark):
    rows = brute.documents(8, 90)
    long = [x for x in rows if len((x[1] or "").split()) > 60][:12]
    edited = []
    for k, x in enumerate(long):
        w = x[1].split(" ")
        for j in range(len(w) // 120 + 1):
            w[len(w) // 2 + 9 * j] = "edit"
        edited.append((500 + k, " ".join(w), *x[2:]))
    rows += edited
    docs = spark.createDataFrame(rows, brute.SCHEMA).select(*cp.COLUMNS)
    left = simhash.without_copies(docs).collect()
    texts = {r.text for r in left}
    assert len(left) == len({r.text or "" for r in left}) and len(left) < len(rows)
    gone = [x for x in rows if x[1] not in texts]
    for x in gone:
        assert any(x[1] == y[1] or near(x[1], y[1]) for y in rows if (y[0] is not None) and (x[0] is None or y[0] <= x[0]) and y is not x)
    missed = [(a, b) for i, a in enumerate(left) for b in left[:i] if (a.text or "").split() and (b.text or "").split() and near(a.text, b.text)]
    assert not missed
    # a number of few bits clashes for most texts: a second hash tells them apart, and the result stays
    assert sorted(simhash.without_copies(docs, bits=3).collect(), key=repr) == sorted(left, key=repr)


def test_edited_copies_of_one_text_all_leave(spark):
    """Copies are alike to the base (0.86), mostly not to each other (0.75): only links to the base join them."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 501):
        w = base[:]
        for at in r.sample(range(200), 3):
            w[at] = f"e{k}x{at}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lone = {k for k, t in rows[1:] if not near(t, rows[0][1]) and not any(near(t, u) for j, u in rows if j != k)}
    for limits in ({}, {"group": 60, "part": 100}):
        left = {x.doc_id for x in simhash.without_copies(docs, **limits).collect()}
        assert left == {0} | lone


def edits(r, kind, words):
    n, w = len(words), words[:]
    if kind == "appended":
        return w + [f"a{r.randrange(10**6)}" for _ in range(n // 5)]
    if kind == "cut":
        return w[: n - n // 10]
    if kind == "block":
        at = r.randrange(n - n // 12)
        return w[:at] + [f"b{r.randrange(10**6)}" for _ in range(n // 12)] + w[at + n // 12 :]
    for at in r.sample(range(n), n // 60):
        w[at] = f"s{r.randrange(10**6)}"
    return w


def test_recall_by_kind_of_edit(spark):
    r = random.Random(6)
    vocabulary = [f"v{i}" for i in range(5000)]
    chance = [1 / (i + 2) for i in range(5000)]
    rows, kinds = [], {}
    for i in range(400):
        kind = ("appended", "cut", "block", "scattered")[i % 4]
        w = r.choices(vocabulary, chance, k=(60, 200, 600)[i % 3])
        pair = [(2 * i, " ".join(w)), (2 * i + 1, " ".join(edits(r, kind, w)))]
        if near(pair[0][1], pair[1][1]):
            kinds.setdefault(kind, []).append(2 * i + 1)
        rows += pair
    left = {x.doc_id for x in simhash.without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {k: sum(i not in left for i in ids) / len(ids) for k, ids in kinds.items()}
    assert all(len(ids) > 40 for ids in kinds.values()) and len(kinds) == 4
    assert min(found.values()) >= 0.98, found
    assert len(left) >= 800 - sum(map(len, kinds.values()))


def test_many_copies_of_one_template(spark):
    """A group larger than what a task may hold: copies are alike to the template (0.81), hardly to each other (0.68)."""
    r = random.Random(7)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    rows = [(0, " ".join(base))]
    for k in range(1, 3001):
        w, at = base[:], r.randrange(5, 45)
        w[at], w[at + 45] = f"e{k}", f"f{k}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert [x.doc_id for x in simhash.without_copies(docs, group=500).collect()] == [0]


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == list(cp.COLUMNS)
        sizes.append((name, docs.count()))
    assert sizes[0][1] < 200 and sizes[1][1] < sizes[0][1] and sizes[2][1] == sizes[1][1]
    packed = cp.best_fit_packing(spark, docs, sf).collect()
    assert len({r.doc_id for r in packed}) <= sizes[1][1] and all(r.offset + r.length <= 2048 for r in packed)


def test_run_and_empty(spark, tmp_path):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 100
    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").filter("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_joined_connects_what_similar_pairs_connect():
    rng = np.random.default_rng(1)
    for trial in range(40):
        n = int(rng.integers(2, 30))
        bases = [np.unique(rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(n):
            base = bases[rng.integers(4)]
            rest = base[rng.random(len(base)) < rng.choice([0.7, 0.9, 0.97, 1])]
            own = np.unique(np.concatenate([rest, rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)]))
            sets.append(own if len(own) else base[:1])
        known = rng.integers(0, n, n) if trial % 2 else np.arange(n)
        side = np.zeros(n, int) if trial % 3 else rng.integers(0, 2, n)
        sketch = np.array([simhash.signature(s)[2] for s in sets], np.uint64)

        def fits(i, j):
            both = len(np.intersect1d(sets[i], sets[j]))
            near = bin(int(sketch[i] ^ sketch[j])).count("1") <= 64 - 40
            return near and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and (not side.any() or side[i] != side[j])

        def classes(pairs):
            of = list(range(n))
            for i, j in [*pairs, *((i, j) for i in range(n) for j in range(i) if known[i] == known[j])]:
                of = [of[i] if x == of[j] else x for x in of]
            return [of.index(x) for x in of]

        got = simhash._joined(known, side, sketch, sets, 40, 0.8)
        assert all(fits(i, j) for i, j in got)
        assert classes(got) == classes([(i, j) for i in range(n) for j in range(i) if fits(i, j)])
