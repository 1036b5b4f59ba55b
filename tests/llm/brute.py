"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def spans(flags):
    n, last = 0, False
    for f in flags:
        n += f and not last
        last = f
    return n


def repeated_bytes(docs, length=200):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = [False] * len(b)
        reach = 0
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                for j in range(max(i, reach), i + length):
                    gone[j] = True
                reach = i + length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans(gone), hashlib.sha256(rest).hexdigest()))
    return out


def repeated_words(docs, length=13):
    lists = [(d, SPLIT.findall(t or "")) for d, t in docs]
    first: dict = {}
    low = lambda d: -(2**70) if d is None else d
    for d, w in lists:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, 2**70), low(d))
    out = []
    for d, w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < low(d):
                gone[i : i + length] = [True] * length
        rest = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(rest.encode()).hexdigest()))
    return out


def quality_counts(text):
    t = text or ""
    w = SPLIT.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(tri)
    hit = {j for i, x in enumerate(tri) if count[x] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPLIT.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def simhash(text, n=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = SPLIT.findall(t)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, bits=3):
    """fps: [(id, fp)] -> {id: smallest id reachable}."""
    ids, root = [d for d, _ in fps], list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, d in enumerate(ids):
        groups[find(i)].append(d)
    return sorted((d, min(groups[find(i)])) for i, d in enumerate(ids))


def documents(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars, key, row, size): passages, near copies, nulls, blanks, ties, long and odd texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñ字") for _ in range(r.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, other = say(70), say(40)
    texts = [None, "", " \t\n ", "a", "ab " * 400, "x" * 3000, say(12), say(13), "\x00 zero \x1c unit\x85 sep  wide", say(6000)]
    for i in range(n):
        t = say(r.randint(1, 120))
        kind = i % 6
        if kind == 1:
            t = say(20) + " " + passage + "  " + say(9)
        elif kind == 2:
            t = say(i % 5) + "\n" + passage[: 150 + 7 * i] + say(3)
        elif kind == 3:
            w = texts[-1].split(" ") if texts[-1] else ["q"]
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 4:
            t = other + "\n" + other + "\n" + say(30) + " " + other.replace(" ", "\t")
        texts.append(t)
    texts += [texts[12], texts[12], passage, passage]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["b", "a", "c", None, "é"]), len(t or ""), "k", "r", -1) for i, t in enumerate(texts)]
    rows += [rows[13], rows[13], (None, texts[14], "en", None, 3, "k", "r", -1), (5, say(50) + passage, "de", "a", 1, "k", "r", -1)]
    r.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, size int"
