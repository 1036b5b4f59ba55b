"""Repeated substrings of a set of strings by merging Burrows-Wheeler transforms.

The strings are dealt to small shards. A shard's transform comes from sorting its own rotations. The transforms are
merged by refining an interleave: rows of all shards stand in the order of the first h bytes of their suffixes, in groups
that agree in them. The transforms say which row is a suffix's extension by one byte and, composed, by h bytes. A pass
deals the extensions, in the order of their suffixes, by the groups of their own first h bytes: that is the order, and the
groups, by 2h bytes. No suffixes of two shards are ever compared. The groups of all passes give the longest common prefix
of neighbours, from the largest h down, and runs of neighbours that have a prefix of the wanted length in common are
the repeated intervals.
"""

from __future__ import annotations

import numpy as np

from .common import byte_units, prefix_hash, span_hash

#: Ends a string; it's no byte of UTF-8.
END = 0xFF
SHARD = 1 << 13
#: Bytes that the first ranking of a shard's rotations looks at.
_FIRST = 7


def rotations(text: np.ndarray) -> np.ndarray:
    """The order of a shard's rotations, by doubling the length that ranks look at; only what stands in a group of equal ranks is sorted again."""
    n, k = len(text), _FIRST
    key = np.zeros(n, np.int64)
    for i in range(k):
        key = key << 8 | np.roll(text, -i)
    order = np.argsort(key)
    key, slot = key[order], np.arange(n)
    # the rank of a rotation is where its group begins
    new = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, np.int64)
    while True:
        rank[order[slot]] = slot[np.maximum.accumulate(np.where(new, np.arange(len(slot)), 0))]
        alone = new & np.append(new[1:], True)
        slot = slot[~alone]
        if not len(slot) or k >= n:
            return order
        rows = order[slot]
        key = rank[rows] * n + rank[(rows + k) % n]
        at = np.argsort(key)
        order[slot], key = rows[at], key[at]
        new, k = np.append(True, key[1:] != key[:-1]), 2 * k


def shards(strings: list[bytes], limit: int = SHARD) -> list[np.ndarray]:
    out, part, size = [], [], 0
    for s in strings:
        part.append(s)
        size += len(s) + 1
        if size >= limit:
            out.append(np.frombuffer(b"".join(x + b"\xff" for x in part), np.uint8))
            part, size = [], 0
    if part:
        out.append(np.frombuffer(b"".join(x + b"\xff" for x in part), np.uint8))
    return out


def _dealt(group: np.ndarray) -> np.ndarray:
    """The stable order of some group numbers, 16 bits at a time."""
    order = np.argsort(group.astype(np.uint16), kind="stable")
    if len(group) and int(group.max()) >> 16:
        order = order[np.argsort((group[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def merged(parts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in the shards laid end to end, longest common prefix with the row before, ``depth`` at most) of all rows, interleaved.

    Shards are cyclic: a suffix goes on at its shard's beginning.
    """
    orders = [rotations(p) for p in parts]
    bases = np.cumsum([0, *(len(p) for p in parts[:-1])])
    # the row of the suffix that is one byte longer: stable order of the transform, shard by shard
    longer = np.concatenate([b + _inverse(np.argsort(p[(o - 1) % len(p)], kind="stable")) for p, o, b in zip(parts, orders, bases)])
    symbol = np.concatenate([p[o].astype(np.uint16) << 8 | p[(o + 1) % len(p)] for p, o in zip(parts, orders)])
    back, h = {1: longer}, 1
    while 2 * h <= depth:
        back[2 * h] = back[h][back[h]]
        h *= 2
    # two bytes of each suffix at once: dealing them out takes as long as one
    row = np.argsort(symbol, kind="stable")
    levels = []
    for h, of in ((1, symbol[row] >> 8), (2, symbol[row]))[:depth]:
        group = np.empty(len(row), np.int32)
        group[row] = np.cumsum(np.append(False, of[1:] != of[:-1]), dtype=np.int32)
        levels.append((h, group))
    while h < depth:
        step = min(h, depth - h)
        extension, old = row, group[row]
        for k in back:
            if step & k:
                extension = back[k][extension]
        own = group[extension]
        order = _dealt(own)
        row, own, old = extension[order], own[order], old[order]
        group = np.empty(len(row), np.int32)
        group[row] = np.cumsum(np.append(False, (own[1:] != own[:-1]) | (old[1:] != old[:-1])), dtype=np.int32)
        h += step
        levels.append((h, group))
    common = np.full(len(row), depth, np.int64)
    common[:1] = 0
    apart = np.flatnonzero(group[row[1:]] != group[row[:-1]]) + 1
    a, b, length = row[apart - 1], row[apart], np.zeros(len(apart), np.int64)
    for h, of in levels[-2::-1]:
        same = np.flatnonzero(of[a] == of[b])
        if h in back and len(same):
            length[same] += h
            on = _inverse(back[h])
            a[same], b[same] = on[a[same]], on[b[same]]
    common[apart] = np.minimum(length, depth)
    return np.concatenate([o + b for o, b in zip(orders, bases)])[row], common


def intervals(common: np.ndarray, length: int) -> np.ndarray:
    """Whether each row of an interleave is in a repeated interval: it has ``length`` bytes in common with the row before or after."""
    with_last = common >= length
    return with_last | np.append(with_last[1:], False)


def promising(strings: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """Runs (string, start, end) of windows of which both halves stand twice or more: only they can repeat as a whole."""
    half = length // 2
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    n = len(text) - length + 1
    if n < 1:
        return []
    prefix = prefix_hash(byte_units(text))
    at = np.arange(len(text) - half + 1)
    found = span_hash(prefix, at, at + half)
    order = np.argsort(found)
    same = found[order][1:] == found[order][:-1]
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    ends = np.cumsum([len(s) + 1 for s in strings])
    starts = np.flatnonzero(twice[:n] & twice[length - half : length - half + n])
    which = np.searchsorted(ends, starts, "right")
    starts, which = (x[starts + length < ends[which]] for x in (starts, which))
    return _runs(starts, which, ends - np.array([len(s) + 1 for s in strings]), length)


def _runs(starts: np.ndarray, which: np.ndarray, bases: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Windows at sorted starts, as runs (string, start, end) of what they cover, where they overlap or touch."""
    if not len(starts):
        return []
    new = np.append(True, (starts[1:] > starts[:-1] + length) | (which[1:] != which[:-1]))
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(starts)) - 1
    base = bases[which[first]]
    return list(zip(which[first].tolist(), (starts[first] - base).tolist(), (starts[last] + length - base).tolist()))


def repeated(strings: list[bytes], length: int, limit: int = SHARD) -> list[tuple[int, int, int]]:
    """Runs (string, start, end) that the strings' repeated substrings of ``length`` bytes cover; each in some string or twice in one."""
    near = promising(strings, length)
    cut = [strings[i][x:y] for i, x, y in near]
    parts = shards(cut, limit)
    if not parts:
        return []
    bases = np.cumsum([0, *(len(s) + 1 for s in cut)])
    position, common = merged(parts, length)
    starts = np.sort(position[intervals(common, length)])
    which = np.searchsorted(bases, starts, "right") - 1
    starts, which = (x[starts + length < bases[which + 1]] for x in (starts, which))
    return [(near[i][0], near[i][1] + x, near[i][1] + y) for i, x, y in _runs(starts, which, bases[:-1], length)]
