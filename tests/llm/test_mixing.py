from concordia.llm import curriculum

from . import brute


def fill(sizes, weights, epochs=3):
    """Targets by sharing the excess again and again."""
    total, target, left = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while left:
        w = sum(weights[i] for i in left)
        full = {i for i in left if rest * weights[i] / w > epochs * sizes[i]}
        if not full:
            for i in left:
                target[i] = rest * weights[i] / w
            break
        for i in full:
            target[i] = epochs * sizes[i]
            rest -= target[i]
        left -= full
    return target


def test_mix(spark):
    rows = brute.documents(7) + [(900 + i, "w " * 4000, "en", "zz", 1, "k", "r", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    got = curriculum.mix(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(brute.SPLIT.findall(t or ""))
    assert sorted(((r.row.doc_id, r.size) for r in got), key=repr) == sorted(((x[0], size(x[1])) for x in rows), key=repr)
    sources = sorted({x[3] for x in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(x[1]) for x in rows if x[3] == s) for s in sources]
    want = dict(zip(sources, fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])))
    for s in sources:
        own = [r for r in got if r.row.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size for r in own)
        assert sum(r.taken for r in own) == round(want[s])
    assert all(0 <= r.first_position <= 1 for r in got)


def test_sequence_follows_schedules(spark):
    rows = [(i, "a b c d e", "en", f"s{i % 3}", 9, "k", "r", 1) for i in range(600)]
    out = curriculum.sequence(curriculum.mix(spark.createDataFrame(rows, brute.SCHEMA))).collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    half = out[: len(out) // 2]
    share = lambda part, s: sum(r.words for r in part if r.row.source == s)
    assert share(half, "s0") > share(out, "s0") / 2 + 50 and share(half, "s2") < share(out, "s2") / 2


def test_no_rows(spark):
    assert curriculum.mix(spark.createDataFrame([], brute.SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, 0, "k", "r", 1), (2, "", "en", "a", 0, "k", "r", 1)], brute.SCHEMA)
    assert {(r.taken, r.target) for r in curriculum.mix(blank).collect()} == {(0, 0.0)}
