"""Source divergence, URL filter and collocations against plain versions."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from concordia.llm import collocations, divergence, queries, url_filter
from concordia.llm.automaton import CountingAutomaton
from concordia.llm.common import looked_up

from . import brute

LOW = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    more = "MIT, the mit. The MIT!  ça Ça\x0bthe mit\tthe mit " * 9
    rows = [*brute.documents(7), *[(900 + i, more, [None, "en", "xx"][i % 3], ["a", None, "", "z"][i % 4], 1, "k", "r", 0) for i in range(24)], (990, "7 8 9", "de", "only digits", 1, "k", "r", 0), (991, None, "zz", "p", 0, "k", "r", 0), (992, "", "zz", "q", 0, "k", "r", 0)]
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def divergences(rows, least=3, top=200):
    texts = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))) for t, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in texts}:
        docs, total, by = Counter(), Counter(), defaultdict(Counter)
        for x, s, w in texts:
            if x == lang:
                docs.update(set(w))
                total.update(w)
                by[s].update(w)
        kept = [t for t in docs if docs[t] >= least]
        p = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))
        shares, q = {s: p(by[s]) for s in by}, p(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in by:
            pairs = [(sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in by if o != s]
            terms = [(f(shares[s][t], q[t]), t) for t in kept if by[s][t] and shares[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked if part == "pair" else ranked[:top])]
    return sorted(out)


@pytest.mark.parametrize("block,top", [(64, 200), (2, 7), (1, 200)])
def test_divergence(docs, block, top):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    got = divergence.audit(docs, block=block, top=top).collect()
    assert sorted(map(tuple, got)) == divergences(rows, top=top)
    assert {(r.source, r.item, r.value) for r in got if r.lang == "zz"} == {("p", "q", 0), ("q", "p", 0)}


def test_divergence_of_nothing(empty):
    assert divergence.audit(empty).count() == 0


def test_shares_are_exact():
    import numpy as np

    big = np.array([0, 1, 10**12, 3 * 10**15], np.int64)
    total = 4 * 10**15 + 7
    assert divergence.share(big, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in big]


def phrases(rows, least, depth, top):
    f, n = defaultdict(Counter), Counter()
    for t, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, depth + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, b in some.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * b >= 80 * some[p[i : i + m]]}
        scored = []
        for p, a in some.items():
            if p not in gone:
                score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,depth,top,shard", [(2, 4, 2000, 100_000), (3, 4, 5, 50), (30, 4, 2000, 1000), (2, 3, 50, 1), (4, 2, 2000, 100)])
def test_collocations(docs, monkeypatch, least, depth, top, shard):
    monkeypatch.setattr(collocations, "SHARD", shard)
    got = collocations.mine(docs, least=least, depth=depth, top=top).collect()
    want = phrases([(r.text, r.lang) for r in docs.collect()], least, depth, top)
    assert sorted(map(tuple, got)) == want and want


def test_collocations_of_nothing(empty, docs):
    assert collocations.mine(empty).count() == 0
    assert collocations.mine(docs, least=10**6).count() == 0


def test_automaton_counts_every_substring():
    import random

    for seed in range(60):
        r = random.Random(seed)
        a, want = CountingAutomaton(), Counter()
        for _ in range(r.randint(1, 8)):
            s = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(1, 12))]
            a.add(s)
            want.update(tuple(s[i : i + n]) for n in range(1, 5) for i in range(len(s) - n + 1))
        found = [(tuple(a.words[i:j]), n) for i, j, n in a.substrings(1, 4)]
        assert len(found) == len({p for p, _ in found}) and dict(found) == dict(want)


URLS = [None, "", "://", "no scheme/at all", "http://", "HTTP://A.NET", "http://net/x", "http://a.NET/", "http://anet/x", "http://user@b.net:80/x?y", "http://example.net/en/1", "http://x.example.net/en", "http://x.EXAMPLE.net/en/a#b", "http://example.com/de/?q", "http://www.example.com/DE/1", "http://q.org/fr/é", "http://org/fr/", "https://w.org/fr", "a://b://c.net/d", "http://字.example.org/fr/字?" + "z" * 3000]


def pages(spark):
    more = [f"http://{'good' if i % 2 else 'bad'}{i % 7}.{['org/fr/', 'net/de/', 'example.com/de/', 'other.com/xy/'][i % 4]}{i * 37 % 101}" for i in range(120)]
    rows = [(i, u, "h", "b") for i, u in enumerate([*URLS, *more, *more[:9], *[more[3]] * 40])] + [(None, more[3], "h", "b"), (5, more[7], "h", "b")]
    return spark.createDataFrame(rows, "page_id long, url string, host string, weight string").repartition(3)


def plain_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
    fits = [r for r in url_filter.RULES if (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith("/" + p))(*r.split("/", 1))]
    return host, path, max(fits, key=len, default=None)


def plain_scores(urls, order):
    """url -> mean logarithm of the ratio of two recursively defined models, and the threshold."""
    import hashlib

    text = {u: (plain_rule(u)[0] + u.split("://", 1)[1][len(plain_rule(u)[0]) :] if "://" in u else u) for u in urls if u}
    held = {u: hashlib.md5(u.encode()).hexdigest()[0] in "0123" for u in text}
    label = {u: (url_filter.RULES[r] if (r := plain_rule(u)[2]) else None) for u in text}
    models = {}
    for m in ("allow", "block"):
        seen = defaultdict(Counter)
        for u, t in text.items():
            if label[u] == m and not held[u]:
                for i in range(len(t)):
                    for k in range(min(order, i) + 1):
                        seen[t[i - k : i]][t[i]] += 1
        models[m] = seen

    def p(m, before, c):
        shorter = p(m, before[1:], c) if before else 1 / url_filter.ALPHABET
        own = models[m].get(before)
        return (own[c] + len(own) * shorter) / (sum(own.values()) + len(own)) if own else shorter

    score = {}
    for u, t in text.items():
        if t and (label[u] is None or held[u]):
            each = [math.log(p("allow", t[max(0, i - order) : i], t[i])) - math.log(p("block", t[max(0, i - order) : i], t[i])) for i in range(len(t))]
            score[u] = sum(each) / len(t)
    bins = {u: math.floor(s * 1000) for u, s in score.items() if label[u]}
    right = lambda b: sum((bins[u] >= b) for u in bins if label[u] == "allow") * sum(label[u] == "block" for u in bins) + sum((bins[u] < b) for u in bins if label[u] == "block") * sum(label[u] == "allow" for u in bins)
    least = min(set(bins.values()), key=lambda b: (-right(b), abs(b), b)) / 1000
    return score, least


@pytest.mark.parametrize("order", [0, 2, 5])
def test_url_filter(spark, order):
    table = pages(spark)
    score, least = plain_scores({r.url for r in table.collect()}, order)
    got = url_filter.judge(table, order=order).collect()
    want = Counter((r.page_id, r.url) for r in table.collect())
    assert len(got) == sum(want.values())
    urls = {r.page_id: r.url for r in table.collect()}
    for r in got:
        u = urls[r.id] if r.id != 5 and r.id is not None else None
        if u is None:
            continue
        assert (r.host, r.path, r.rule) == plain_rule(u)
        if r.rule:
            assert r.verdict == url_filter.RULES[r.rule] and r.score is None
        else:
            assert abs(r.score - score.get(u, 0.0)) < 2e-5
            if u not in score or abs(r.score - least) > 1e-3:
                assert r.verdict == ("allow" if u not in score or r.score >= least else "block"), (u, r.score, least)
    assert {r.verdict for r in got if not r.rule} == {"allow", "block"}


def test_url_filter_without_models(spark):
    table = pages(spark)
    only = url_filter.judge(table, rules={"net/": "block"}).collect()
    assert {r.verdict for r in only if not r.rule} == {"allow"} and {r.score for r in only if not r.rule} == {0.0}
    assert {r.verdict for r in url_filter.judge(table, rules={}).collect()} == {"allow"}
    assert url_filter.judge(table.filter("false")).count() == 0


def test_url_sql_on_odd_urls(spark):
    table = pages(spark)
    con = duckdb.connect()
    con.register("pages", table.toPandas().astype({"page_id": "Int64"}))
    want = con.execute(queries.ORACLE_SQL["op12_url_filter"]).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, url_filter.judge(table).collect()), key=key) == sorted(want, key=key)


def test_looked_up_keeps_all_rows(spark):
    rows = spark.createDataFrame([(i, None if i % 9 == 0 else "hot" if i % 2 else f"k{i % 13}") for i in range(500)], "i int, k string")
    found = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(0, 13, 2))], "k string, v int")
    plain = sorted(map(tuple, rows.join(found, "k", "left").select("i", "k", "v").collect()))
    for most in (2, 20, 10_000):
        assert sorted(map(tuple, looked_up(rows, "k", found, most).select("i", "k", "v").collect())) == plain
