"""String similarities between 0 and 1. Case is folded; two empty strings are alike (1), an empty and a full one aren't (0).

Those that Spark's functions can express are Columns; the others are Arrow-batched UDFs, for candidate pairs only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that cameras confuse, and what a confusion costs.
CONFUSABLE = {"0": "OD", "O": "0D", "D": "0O", "1": "I", "I": "1", "8": "B", "B": "8", "5": "S", "S": "5", "2": "Z", "Z": "2", "6": "G", "G": "6"}
CONFUSED = 0.2
# Below so many pairs of equal lengths, or over so many different signs, each pair is measured by itself; and how many numbers are held at once.
TOGETHER, SIGNS, HELD = 16, 512, 4_000_000
SOUNDEX = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}


def fold(c: Column) -> Column:
    return F.upper(F.coalesce(c, F.lit("")))


def _ends(x: Column, y: Column, value: Column) -> Column:
    return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).otherwise(value)


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(fold(a), fold(b))


def edit(a: Column, b: Column) -> Column:
    x, y = fold(a), fold(b)
    return _ends(x, y, 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)))


def qgrams(c: Column, q: int = 2) -> Column:
    """All q-grams of the folded text with q - 1 signs of padding at each end, repeats included; none of an empty text."""
    t = F.concat(F.lit("#" * (q - 1)), fold(c), F.lit("#" * (q - 1)))
    return F.when(fold(c) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - q + 1), lambda i: F.substring(t, i, F.lit(q))))


def overlap_count(a: Column, b: Column, q: int = 2) -> Column:
    return F.size(F.array_intersect(qgrams(a, q), qgrams(b, q)))


def overlap(a: Column, b: Column, q: int = 2) -> Column:
    x, y = (F.size(F.array_distinct(qgrams(c, q))) for c in (a, b))
    return _ends(fold(a), fold(b), overlap_count(a, b, q) / F.greatest(F.least(x, y), F.lit(1)))


def jaccard(a: Column, b: Column, q: int = 2) -> Column:
    return _ends(fold(a), fold(b), overlap_count(a, b, q) / F.greatest(F.size(F.array_union(qgrams(a, q), qgrams(b, q))), F.lit(1)))


def soundex_code(c: Column) -> Column:
    """First letter and three digits: W and H are dropped first, and the first letter's own digit isn't collapsed with the next."""
    letters = F.regexp_replace(fold(c), "[^A-Z]", "")
    rest = F.regexp_replace(F.substring(letters, 2, 10_000), "[WH]", "")
    digits = F.regexp_replace(F.translate(rest, "".join(SOUNDEX), "".join(d * len(k) for k, d in SOUNDEX.items())), r"([0-9])\1+", "$1")
    return F.when(letters == "", "").otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), F.regexp_replace(digits, "[^0-9]", "")), 4, "0"))


def soundex(a: Column, b: Column) -> Column:
    return _ends(fold(a), fold(b), F.when(soundex_code(a) == soundex_code(b), 1.0).otherwise(0.0))


def weighted_distance(x: str, y: str, cost) -> float:
    """Edit distance whose substitutions cost what cost(a, b) says; insertions and deletions 1."""
    row = [float(j) for j in range(len(y) + 1)]
    for i, a in enumerate(x, 1):
        diagonal, row[0] = row[0], float(i)
        for j, b in enumerate(y, 1):
            here = diagonal if a == b else diagonal + cost(a, b)
            diagonal, row[j] = row[j], min(here, row[j] + 1, row[j - 1] + 1)
    return row[-1]


def confusion_cost(a: str, b: str) -> float:
    return CONFUSED if b in CONFUSABLE.get(a, "") else 1.0


def _jaro(x: str, y: str) -> float:
    if x == y:
        return 1.0
    reach, used, left = max(max(len(x), len(y)) // 2 - 1, 0), set(), []
    for i, a in enumerate(x):
        at = next((j for j in range(max(0, i - reach), min(len(y), i + reach + 1)) if j not in used and y[j] == a), None)
        if at is not None:
            used.add(at)
            left.append(a)
    c = len(left)
    if not c:
        return 0.0
    moved = sum(a != y[j] for a, j in zip(left, sorted(used)))
    return (c / len(x) + c / len(y) + (c - moved / 2) / c) / 3


def _common(x: str, y: str) -> int:
    """Characters in the longest common substring (the first of the longest) and, in turn, to its left and right."""
    total, todo = 0, [(x, y)]
    while todo:
        a, b = todo.pop()
        best, i, j, row = 0, 0, 0, [0] * (len(b) + 1)
        for p, s in enumerate(a):
            new = [0] * (len(b) + 1)
            for q, t in enumerate(b):
                if s == t:
                    new[q + 1] = row[q] + 1
                    if new[q + 1] > best:
                        best, i, j = new[q + 1], p + 1, q + 1
            row = new
        if best:
            total += best
            todo += [(a[: i - best], b[: j - best]), (a[i:], b[j:])]
    return total


def _codes(texts: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), n)


def weighted_distances(xs: list[str], ys: list[str], cost) -> np.ndarray:
    """weighted_distance() of pairs of texts that all have the same two lengths, step by step for all pairs at once."""
    m, n = len(xs[0]), len(ys[0])
    signs, at = np.unique(np.concatenate([_codes(xs, m).ravel(), _codes(ys, n).ravel()]), return_inverse=True)
    if len(xs) < TOGETHER or len(signs) > SIGNS:
        return np.array([weighted_distance(x, y, cost) for x, y in zip(xs, ys)])
    x, y = at[: len(xs) * m].reshape(-1, m).T, at[len(xs) * m :].reshape(-1, n).T
    names = [chr(c) for c in signs]
    table = np.array([[0.0 if a == b else cost(a, b) for b in names] for a in names])
    row = np.repeat(np.arange(n + 1, dtype="float64")[:, None], len(xs), 1)
    for i in range(1, m + 1):
        diagonal, row[0] = row[0].copy(), float(i)
        for j in range(1, n + 1):
            here = diagonal + table[x[i - 1], y[j - 1]]
            diagonal = row[j].copy()
            row[j] = np.minimum(here, np.minimum(diagonal, row[j - 1]) + 1)
    return row[n]


def jaros(xs: list[str], ys: list[str]) -> np.ndarray:
    """_jaro() of pairs of texts that all have the same two lengths, step by step for all pairs at once."""
    if len(xs) < TOGETHER:
        return np.array([_jaro(x, y) for x, y in zip(xs, ys)])
    m, n = len(xs[0]), len(ys[0])
    x, y = _codes(xs, m), _codes(ys, n)
    reach = max(max(m, n) // 2 - 1, 0)
    met, used = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    for i in range(m):
        for j in range(max(0, i - reach), min(n, i + reach + 1)):
            here = (x[:, i] == y[:, j]) & ~met[:, i] & ~used[:, j]
            met[:, i] |= here
            used[:, j] |= here
    # those that were met come first, in their order
    first = lambda codes, which: np.take_along_axis(codes, np.argsort(~which, axis=1, kind="stable"), 1)[:, : min(m, n)]
    c = met.sum(1)
    moved = ((first(x, met) != first(y, used)) & (np.arange(min(m, n)) < c[:, None])).sum(1)
    of = np.maximum(c, 1)
    value = np.where(c > 0, (c / m + c / n + (c - moved / 2) / of) / 3, 0.0)
    return np.where((x == y).all(1), 1.0, value) if m == n else value


def _together(measure):
    """A UDF of a measure that takes pairs whose texts have the same two lengths together."""

    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        out, by = np.zeros(len(a)), {}
        xs, ys = ([("" if v is None or v != v else v.upper()) for v in s] for s in (a, b))
        for i, (x, y) in enumerate(zip(xs, ys)):
            if x and y:
                by.setdefault((len(x), len(y)), []).append(i)
            else:
                out[i] = float(x == y)
        for (m, n), rows in by.items():
            size = max(1, HELD // (m + n))
            for k in range(0, len(rows), size):
                own = rows[k : k + size]
                out[own] = measure([xs[i] for i in own], [ys[i] for i in own])
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(each, "double")


def _udf(measure):
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = ("" if v is None or v != v else v.upper() for v in (x, y))
            out.append(float(x == y) if not x or not y else measure(x, y))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(each, "double")


def jaro(a: Column, b: Column) -> Column:
    """Half the moved characters are subtracted, not rounded down first."""
    return _together(jaros)(a, b)


def jaro_winkler(a: Column, b: Column, weight: float = 0.1, known: Column | None = None) -> Column:
    """known: their jaro(), if it is there."""
    x, y = fold(a), fold(b)
    same = F.lit(0)
    for n in range(1, 5):
        same = F.when((F.length(x) >= n) & (F.length(y) >= n) & (F.substring(x, 1, n) == F.substring(y, 1, n)), n).otherwise(same)
    j = jaro(a, b) if known is None else known
    return j + same * weight * (1 - j)


def ratcliff(a: Column, b: Column) -> Column:
    return _udf(lambda x, y: 2.0 * _common(x, y) / (len(x) + len(y)))(a, b)


def weighted_edit(a: Column, b: Column, costs: dict[tuple[str, str], float] | None = None) -> Column:
    """1 less the weighted distance by the longer length; costs are of pairs of characters, else those of confusions."""

    def cost(p: str, q: str) -> float:
        return costs.get((p, q), costs.get((q, p), confusion_cost(p, q))) if costs else confusion_cost(p, q)

    return _together(lambda xs, ys: 1 - weighted_distances(xs, ys, cost) / max(len(xs[0]), len(ys[0])))(a, b)


MEASURES = {"edit": edit, "ocr_edit": weighted_edit, "jaro": jaro, "jaro_winkler": jaro_winkler, "overlap": overlap, "jaccard": jaccard, "ratcliff": ratcliff, "soundex": soundex}
