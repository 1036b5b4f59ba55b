import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.llm import importance, language_id, license_scan, packing, quality_rules, simhash, syncmers
from concordia.llm.common import kept

from . import brute


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.documents(4), brute.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_quality_counts(docs, empty):
    got = quality_rules.compression_bands(docs).collect()
    want = sorted(((d, *brute.quality_counts(t)) for d, t in pairs(docs)), key=repr)
    assert sorted((tuple(r)[:7] for r in got), key=repr) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert quality_rules.compression_bands(empty).count() == 0


def test_bands_reject_repetition_and_noise(spark):
    noise = "".join(chr(33 + int(x)) + " " * int(x % 7 == 0) for x in np.random.default_rng(1).integers(0, 94, 6000))
    rows = [(1, "the same few words again " * 400), (2, noise), (3, " ".join(t for _, t, *_ in brute.documents(6) if t and "x" * 9 not in t and "ab ab" not in t))]
    got = {r.doc_id: r for r in quality_rules.compression_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not quality_rules.in_band(len(rows[0][1]), got[1].ratio)
    assert not got[2].kept


def test_simhash(docs, empty, spark):
    got = {(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs.filter("doc_id is not null")).collect()}
    fps = [(d, brute.simhash(t)) for d, t in pairs(docs) if d is not None]
    roots = brute.components(fps)
    assert got == {(d, f, c) for (d, f), (e, c) in zip(sorted(fps), roots)}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(docs).filter("doc_id is null").count() == 1


@pytest.mark.parametrize("group", [2, 50, 4096])
def test_links_of_dense_groups(spark, group):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << r.integers(0, 64, k, dtype=np.uint64)) if k else np.uint64(0) for k in r.integers(0, 5, 700)]
    fps = sorted({int(base[i % 40 if i % 3 else 0] ^ f) for i, f in enumerate(flips)} | {0, 2**64 - 1})
    rows = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    from concordia.llm.components import components

    found = components(simhash.links(spark.createDataFrame(rows, "fp long").selectExpr("fp", "fp node", "0L sketch", "0 salt"), group=group)).collect()
    signed = [(int(np.uint64(f).view(np.int64)), f) for f in fps]
    want = dict(brute.components(signed))
    mine = {x.node: x.root for x in found}
    assert {k: mine.get(k, k) for k in want} == want


def test_language_profiles(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the tree " * 5, "en"), ("das Haus und der Baum " * 5, "de"), ("the cat", None), ("the thin man", "en"), ("der Mann und das Kind", "de")] * 3)]
    rows += [(99, None, None), (98, "12 34 !!", "en"), (97, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = kept(language_id.profiles(d.filter("lang is not null"), "text", "lang"))
    got = {r.doc_id: r for r in language_id.identify(d, learned, ["doc_id"]).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang and i < 90)
    assert [got[i].lang_pred for i in (97, 98, 99)] == ["und"] * 3
    none = language_id.identify(d, learned.filter("false"), ["doc_id"])
    assert {r.lang_pred for r in none.collect()} == {"und"}
    language_id.BLOCK, before = 1, language_id.BLOCK
    try:
        assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(d, learned, ["doc_id"]).collect()} == {k: (v.lang_pred, v.score) for k, v in got.items()}
    finally:
        language_id.BLOCK = before


def test_packing(docs, empty, spark):
    path = packing.tokenizer_path()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = []
    for d, t in pairs(docs):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want.append((d, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.pack(packing.pieces(docs, capacity=256), 256).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 256 + 1
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_local_search_of_a_small_plan():
    plan = packing.best_fit({6: 2, 5: 2, 4: 3}, 15)
    assert sum(sum(b) * n for b, n in plan.items()) == 34 and all(sum(b) <= 15 for b in plan)
    better = packing.improve(packing.Counter({(9, 4): 2, (8, 3): 1, (3,): 1}), 15)
    assert sum(better.values()) < 4
    assert sum(sum(b) * n for b, n in better.items()) == 40


def test_syncmers(docs, empty, spark):
    got = syncmers.fingerprints(docs).collect()
    rows = sorted(((d is None, d or 0, t or "") for d, t in pairs(docs)))
    assert len(got) == len(rows)
    import hashlib

    want = []
    for i, (none, d, t) in enumerate(rows):
        nxt, cut = rows[(i + 1) % len(rows)][2], len(t) // 4
        want.append((None if none else d, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 300]
    assert sum(r.near_edited for r in long) / len(long) > 0.35
    assert syncmers.fingerprints(empty).count() == 0


def test_syncmers_do_not_depend_on_context(spark):
    w = [f"w{i * 7 % 53}x{i}" for i in range(60)]
    rows = [(1, " ".join(w)), (2, " ".join(["other", *w[20:40], "words"])), (3, " ".join(w[20:40]))]
    d = syncmers.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text"), "f", 1000)
    a, b, inner = ({(x.h, x.p) for x in r.f.anchors} for r in d.orderBy("doc_id").collect())
    assert inner and {(h, p + 20) for h, p in inner} <= a and {(h, p + 1) for h, p in inner} <= b


def test_likeness_against_plain_matching(spark):
    r = np.random.default_rng(9)
    word = lambda n: [f"v{x}" for x in r.integers(0, 400, n)]
    base = word(3000)
    texts = [base, base[:2000] + word(900), base[1500:] + base[:1500], word(50), base[:40], [], ["one"], ["ab"] * 500, base]
    rows = [(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    d = spark.createDataFrame(rows, "i long, x string, y string").repartition(4)
    d = syncmers.with_likeness(syncmers.with_fingerprint(syncmers.with_fingerprint(d, F.col("x"), "a"), F.col("y"), "b"), "a", "b", "near")
    for row in d.collect():
        bits = max(row.a.bits, row.b.bits)
        x, y = ({z.h: z.p for z in f.anchors if z.h % 2**bits == 0} for f in (row.a, row.b))
        assert len(row.a.anchors) == len({z.h for z in row.a.anchors}) <= 160
        moved = sorted(y[h] - p for h, p in x.items() if h in y)
        drift = max(16.0, 0.02 * max([*x.values(), *y.values(), 0]))
        n = sum(abs(m - moved[(len(moved) - 1) // 2]) <= drift for m in moved)
        want = 1.0 if not row.a.anchors and not row.b.anchors else n / max(1, len(x) + len(y) - n)
        assert row.near == pytest.approx(want)
        assert row.x != row.y or row.near == 1.0
    near = {(r.i // len(texts), r.i % len(texts)): r.near for r in d.select("i", "near").collect()}
    assert near[0, 1] > 0.4 and 0.2 < near[0, 2] < 0.8 and near[0, 3] == 0


def test_importance(docs, empty, spark):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = importance.resample(docs, labels).collect()
    assert len(got) == docs.count() and sum(r.selected for r in got) == len(got) // 2
    least = min(r.gumbel_key for r in got if r.selected)
    assert all(r.gumbel_key <= least for r in got if not r.selected)
    assert importance.resample(empty, labels).count() == 0
    assert all(r.kept for r in importance.resample(docs, labels.filter("false")).collect())


def test_importance_weighs_documents_by_their_log_ratio(docs, spark):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, quality int")
    got = importance.resample(docs, labels).withColumn("noise", importance.gumbel("doc_id")).filter("doc_id is not null").collect()
    assert any(abs(r.log_ratio - r.mean) > 1 for r in got)
    assert all(abs(r.gumbel_key - r.log_ratio - r.noise) < 1e-6 for r in got)


def test_license_scan(docs, empty, spark):
    texts = [t for t in license_scan.TEMPLATES.values()]
    rows = [(i, f"some words before it\n{t}\nand after") for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, "mit license"), (53, "word " * 3000 + texts[2])]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r.doc_id, r.license) for r in got.collect()}
    assert found >= {(i, n) for i, n in enumerate(license_scan.TEMPLATES)} | {(53, [*license_scan.TEMPLATES][2])}
    assert not {d for d, _ in found} & {50, 51, 52}
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(empty).count() == 0


def test_language_id_cases(spark):
    rows = [(1, "the cat and the dog " * 30, "en"), (2, "der hund und die katze " * 30, "de"), (3, "der hund und die katze " * 30, "dd"), (4, None, "en"), (5, "", None)]
    learned = kept(language_id.profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string").filter("lang is not null"), "text", "lang"))
    asked = [(1, "the dog", "x"), (1, "the dog", "x"), (2, "katze " * 60_000, None), (3, None, "de"), (4, "12 34 ...", "de"), (None, "und die", "en"), (6, "\u5b57\u5b57", "en")]
    docs = spark.createDataFrame(asked, "doc_id long, text string, lang_pred string")
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in language_id.identify(docs.select("doc_id", "text"), learned, ["doc_id"]).collect()), key=repr)
    # dd and de have equal profiles: the first in order wins
    assert got == sorted([(1, "en"), (1, "en"), (2, "dd"), (3, "und"), (4, "und"), (0, "dd"), (6, got[-1][1])], key=repr) and got[-1][1] != "und"
    assert language_id.identify(docs.filter("false").select("doc_id", "text"), learned, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.select("doc_id", "text"), learned.filter("false"), ["doc_id"]).collect()} == {"und"}


def test_language_id_on_held_out_documents(spark):
    from concordia.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 20 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


def test_importance_against_plain_counts(docs, spark):
    """Weights, ratios and the sample, from buckets of single words, pairs and edges counted one by one."""
    from collections import Counter
    from math import log

    import pyarrow as pa

    def bucket(words):
        """The last bucket of a few words' own features: of one word it's the word's, of two the pair's comes before two edges."""
        found = next(b for _, _, b, _ in importance.features(pa.array([b" ".join(words).decode()])))
        return int(found[{1: 0, 2: 2}[len(words)]])

    def buckets(text):
        w = (text or "").encode().split()
        whole = [x.tolist() for _, _, x, _ in importance.features(pa.array([text], pa.string()))]
        whole = whole[0] if whole else []
        plain = [bucket([x]) for x in w] + [bucket(w[i : i + 2]) for i in range(len(w) - 1)]
        assert whole[: len(plain)] == plain and len(whole) == max(0, len(plain) + len(w))
        return whole

    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "doc_id long, quality int")
    chosen = {r["_id"]: r for r in importance.labelled(labels, "doc_id", "quality").collect()}
    raw, target = Counter(), Counter()
    mine = {}
    for d, t in pairs(docs):
        b = mine[d, t] = mine.get((d, t)) or buckets(t) if len((t or "").split()) < 3000 else [x.tolist() for _, _, x, _ in importance.features(pa.array([t], pa.string()))][0]
        raw.update(b)
        if d in chosen and chosen[d]["good"] == 1 and chosen[d]["fold"] == 0:
            target.update(b)
    n, m, k = sum(raw.values()), sum(target.values()), importance.BUCKETS
    share = lambda x: (raw[x] + 1) / (n + k)
    weight = lambda x: log((target[x] + k * share(x)) / (m + k) / share(x))
    weights, cut = importance.fit(docs, labels)
    assert all(weights[x] == pytest.approx(weight(x)) for x in list(raw)[:500])
    got = importance.resample(docs, labels)
    rows = got.collect()
    want = [sum(map(weight, b)) for b in mine.values()]
    assert {round(r.log_ratio, 6) for r in rows} == {round(x, 6) for x in want}
    assert all(r.kept == (r.mean >= cut) for r in rows)
    best = sorted(r.gumbel_key for r in rows)[-(len(rows) // 2) :]
    assert sorted(r.gumbel_key for r in rows if r.selected) == best


@pytest.mark.parametrize("few", [1, 7, 10_000])
def test_top_k_with_outliers_and_ties(spark, few):
    values = [1e12, -1e9, *(i / 977 for i in range(500)), *[0.25] * 60, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").repartition(3)
    for k in (0, 1, 2, 100, 300, 420, len(values) - 1, len(values), 10_000):
        got = {r.i for r in importance.top_k(df, "v", k, "i", few).filter("selected").collect()}
        low = min(v for v in values if v is not None)
        assert got == set(sorted(range(len(values)), key=lambda i: (-(low if values[i] is None else values[i]), i))[:k])


def test_bands_are_fitted_to_good_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").select("doc_id", "text", "quality").collect()]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    bands = quality_rules.fit(docs, labels)
    quality = {r[0]: r[2] for r in rows}
    judged = [(quality[r.doc_id], r.kept) for r in quality_rules.compression_bands(docs, bands=bands).collect() if not r.base_failed]
    share = lambda q: sum(k for g, k in judged if g == q) / sum(g == q for g, _ in judged)
    assert share(1) > 0.95 and share(0) < 0.4
    assert quality_rules.fit(docs, labels.filter("false")) == quality_rules.BANDS


def test_local_search_empties_bins():
    import random
    from collections import Counter

    r, gap, emptied = random.Random(3), 0, 0
    for _ in range(400):
        capacity = r.choice([10, 20, 50])
        counts = Counter(r.randint(1, capacity) if r.random() < 0.5 else r.randint(capacity // 5, capacity // 2) for _ in range(r.randint(3, 30)))
        first = packing.best_fit(counts, capacity)
        better = packing.improve(first, capacity)
        pieces = Counter()
        for bins, n in better.items():
            assert sum(bins) <= capacity and n > 0
            for x in bins:
                pieces[x] += n
        assert pieces == counts and sum(sum(b) ** 2 * n for b, n in better.items()) >= sum(sum(b) ** 2 * n for b, n in first.items())
        gap += sum(first.values()) + sum(-k * v for k, v in counts.items()) // capacity
        emptied += sum(first.values()) - sum(better.values())
    assert emptied >= 10 and gap > emptied
    # one at a time: swaps alone fill both bins
    assert sum(packing.improve(Counter({(6, 3): 1, (5, 4): 1, (2,): 1}), 10).values()) == 2


def test_license_containment_at_its_bound(spark):
    words = license_scan.TEMPLATES["MIT-text"].split()
    n = len(words)
    cut = lambda share: " ".join(words[: int(n * share)])
    rows = [(1, cut(0.9)), (2, cut(0.7)), (3, "before it " + " ".join(words) + " after"), (3, "before it " + " ".join(words) + " after"), (4, " ".join(f"x{i}" if i % 40 == 3 else w for i, w in enumerate(words)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.containment) for r in license_scan.scan(docs).filter("license = 'MIT-text'").collect()]
    assert sorted(d for d, _ in got) == [1, 3, 3, 4] and all(c >= 0.8 for _, c in got)
    for block in (1, 10**6):
        license_scan.BLOCK, old = block, license_scan.BLOCK
        try:
            assert license_scan.scan(docs).count() == license_scan.scan(docs.filter("true")).count() == len(got) + license_scan.scan(docs).filter("license <> 'MIT-text'").count()
        finally:
            license_scan.BLOCK = old
    assert license_scan.scan(docs, templates={}).count() == 0


def test_all_labelled_rows_count(spark):
    """More labels than a sample of 20,000 would take; the cut equals that of a plain search, however the ranges fall."""
    many = spark.range(25_000).select("id", (F.col("id") % 3 > 0).cast("int").alias("quality"))
    assert importance.labelled(many, "id", "quality").count() == 25_000
    r = np.random.default_rng(4)
    for n, few in ((0, 10), (1, 10), (60, 7), (400, 50), (400, 10_000)):
        good = r.integers(0, 2, n)
        mean = np.round(r.normal(size=n) + 0.4 * good, 1)
        seen = spark.createDataFrame([*zip(good.tolist(), mean.tolist())], "good int, mean double")
        g, b = np.sort(mean[good == 1]), np.sort(mean[good == 0])
        want = -np.inf
        if len(g) and len(b):
            at = np.unique(mean)
            cuts = np.append((at[1:] + at[:-1]) / 2, at[0] - 1)
            want = cuts[int(np.argmax((1 - np.searchsorted(g, cuts) / len(g)) + np.searchsorted(b, cuts) / len(b)))]
        assert importance.cut_of(seen, few) == want
