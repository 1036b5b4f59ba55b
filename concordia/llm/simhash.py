"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits are cut into two segments of 32 bits instead of
four: one segment then differs by at most one bit. Each segment is indexed by 32 variants, each with one bit
as a wildcard; two segments that differ by at most one bit share a variant, so an equality join on variants
finds every pair, and the full distance verifies it. Only different fingerprints are indexed, so groups
of equal texts of any size cost one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, kept, marked, mix, partitions, stored
from .components import components

BITS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that share a variant and are compared with each other in a task; larger groups are indexed further.
GROUP = 2_048
_U = np.uint64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it's set in over half of the hashes of the text's word shingles, repeats included; without words 0."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp) of every row, fp as a signed 64-bit number. Null and empty texts have 0."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, fp long")


def variants(values: np.ndarray, low: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the one-wildcard variants of the bits [low, low + width): which bit is free, and the others."""
    part = (values >> _U(low)) & _U((1 << width) - 1)
    free = np.arange(width, dtype=_U)
    keys = (part[:, None] & ~(_U(1) << free)) | (free << _U(width)) | _U(low << 40)
    return keys.ravel(), np.repeat(np.arange(len(values)), width)


class _Rows:
    """Fingerprints, the nodes that they belong to and their sketches, as columns of equal length."""

    def __init__(self, fp, node, sketch):
        self.fp, self.node, self.sketch = fp, node, sketch

    def __len__(self):
        return len(self.fp)

    def __getitem__(self, at) -> _Rows:
        return _Rows(self.fp[at], self.node[at], self.sketch[at])

    def __add__(self, other: _Rows) -> _Rows:
        return _Rows(*(np.concatenate(x) for x in zip((self.fp, self.node, self.sketch), (other.fp, other.node, other.sketch))))

    def likeness(self, other: _Rows, bits: int) -> np.ndarray:
        """How many sketch bits agree, or -1 where fingerprints differ in more than ``bits``."""
        same = 64 - np.bitwise_count(self.sketch ^ other.sketch).astype(np.int16)
        return np.where(np.bitwise_count(self.fp ^ other.fp) <= bits, same, -1)


_NONE = _Rows(*(np.zeros(0, _U),) * 3)
_OUT = "kind byte, a long, b long, node long, sketch long"


def _edges(a: _Rows, b: _Rows) -> pa.RecordBatch:
    return _batch(0, a.node, b.node, a.node, a.sketch)


def _batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int8)), *(pa.array(c.view(np.int64)) for c in columns)], names=["kind", "a", "b", "node", "sketch"])


def _links(rows: _Rows, bits: int, need: int) -> tuple[_Rows, _Rows]:
    """A spanning forest of the links among some rows, by the likest links: fewer edges than rows, and memory in proportion to rows.

    Rows are taken one by one, always the one most alike to a row taken before; a row that none is near begins a new tree.
    """
    n = len(rows)
    best, parent, left = np.full(n, -1, np.int16), np.zeros(n, np.int64), np.arange(n)
    a, b = [], []
    while len(left):
        i = int(np.argmax(best[left]))
        at = int(left[i])
        if best[at] >= max(need, 0):
            a.append(int(parent[at]))
            b.append(at)
        left = np.delete(left, i)
        like = rows[at : at + 1].likeness(rows[left], bits)
        closer = left[like > best[left]]
        best[left] = np.maximum(best[left], like)
        parent[closer] = at
    return rows[np.array(a, np.int64)], rows[np.array(b, np.int64)]


def _small(keys: np.ndarray, rows: _Rows, bits: int, need: int) -> tuple[_Rows, _Rows]:
    """Links of many small groups at once: rows sorted by key are compared with the next, the one after it, and so on."""
    a, b, step = _NONE, _NONE, 1
    while step < len(keys):
        same = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(same):
            break
        near = same[rows[same].likeness(rows[same + step], bits) >= need]
        a, b, step = a + rows[near], b + rows[near + step], step + 1
    return a, b


def _grouped(bits: int, need: int, group: int, deeper):
    """Reads (key, fp, node, sketch) sorted by key. kind 0: a link of nodes a, b. kind 1: a row of a group of over ``group`` rows, for deeper: key a, fp b.

    A group is held only up to ``group`` rows; the rest of a larger one streams through.
    """

    def run(batches):
        key, held, large = None, _NONE, False

        def close():
            if len(held) > 1 and not large:
                a, b = _links(held, bits, need)
                if len(a):
                    yield _edges(a, b)

        for batch in batches:
            keys, *rest = (c.to_numpy(zero_copy_only=False).view(_U) for c in batch.columns)
            rows = _Rows(*rest)
            if not len(keys):
                continue
            edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(edge, len(keys)))
            whole = np.zeros(len(edge), bool)
            whole[1:-1] = sizes[1:-1] <= 16
            inside = np.repeat(whole, sizes)
            a, b = _small(keys[inside], rows[inside], bits, need)
            if len(a):
                yield _edges(a, b)
            for at, n in zip(edge[~whole], sizes[~whole]):
                if keys[at] != key:
                    yield from close()
                    key, held, large = keys[at], _NONE, False
                new = rows[at : at + n]
                if not large and len(held) + n > group and deeper:
                    large, new, held = True, held + new, _NONE
                if large:
                    sub, row = deeper(key, new.fp)
                    yield _batch(1, sub, new.fp[row], new.node[row], new.sketch[row])
                else:
                    held = held + new
        yield from close()

    return run


def _deeper(key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variants of the other half of a large group's fingerprints: three bits in two segments of 16 leave one at most in one.

    Rows that share such a key agree in 46 bits, so that at most 2**18 different ones can.
    """
    other = 0 if int(key) >> 40 & 32 else 32
    parts = [variants(fps, other + low, 16) for low in (0, 16)]
    keys, row = (np.concatenate(x) for x in zip(*parts))
    h = (keys ^ (_U(key) * _U(0x9E3779B97F4A7C15))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29)), row


def links(nodes: DataFrame, bits: int = BITS, need: int = 0, group: int = GROUP) -> DataFrame:
    """Edges (a, b) among nodes (node, fp, sketch, salt): fingerprints of one salt with up to ``bits`` (three at most) differing
    bits, and ``need`` equal bits of the sketches.

    Not every pair, but whatever pairs connect is connected. Keys of the deeper index are hashed: a clash only
    brings together rows that are then compared and rejected.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two segments of one-wildcard variants find up to three differing bits")

    def index(batches):
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            for i in range(0, b.num_rows, 4096):
                salt, fp, node, sketch = (c[i : i + 4096] for c in columns)
                for low in (0, 32):
                    keys, row = variants(fp.view(_U), low, 32)
                    keys = keys | (salt[row].astype(_U) << _U(48))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(c[row]) for c in (fp, node, sketch))], names=["key", "fp", "node", "sketch"])

    n = partitions(nodes)
    keyed = nodes.select("salt", "fp", "node", "sketch").distinct().mapInArrow(index, "key long, fp long, node long, sketch long")
    first = stored(keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_grouped(bits, need, group, _deeper), _OUT))
    again = first.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), "node", "sketch")
    again = again.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_grouped(bits, need, group, None), _OUT)
    return first.filter("kind = 0").select("a", "b").unionByName(again.select("a", "b")).distinct()


def linked_fingerprints(rows: DataFrame, first: str, bits: int = BITS) -> DataFrame:
    """(a, b): the smallest ``first`` of all rows that their fp's links lead to, and that of each different fp linked to it."""
    least = rows.groupBy("fp").agg(F.min(first).alias("first"))
    nodes = least.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("sketch"), F.lit(0).alias("salt"))
    classes = least.join(kept(components(links(nodes, bits))), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("a"))
    hubs = classes.join(smallest, "root").select(F.col("fp").alias("f"), "a")
    return rows.join(hubs, F.col("fp") == F.col("f")).filter(F.col("a") != F.col(first)).select("a", F.col(first).alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the smallest id that links lead to, its own included.

    Null, empty and blank texts have fingerprint 0 and are linked like any other; equal rows are linked by it; null
    ids are passed over in the smallest id (null if there's no other); no rows, no result.
    """
    fps = kept(fingerprints(docs, id_col, text_col, shingle))
    least = fps.groupBy("fp").agg(F.min("id").alias("first"))
    nodes = least.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("sketch"), F.lit(0).alias("salt"))
    roots = kept(components(links(nodes, bits)))
    classes = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(smallest, "root").select(F.col("fp").alias("f"), "component_id")
    return fps.join(named, F.col("fp") == F.col("f")).select(F.col("id").alias(id_col), "fp", "component_id")


#: Near copies: words in a shingle, the Jaccard similarity of shingle sets, sketch bits that must agree (6.7 standard deviations under what a similarity of 0.8 gives, 57.6).
NEAR = {"shingle": 5, "similarity": 0.8, "need": 44}
#: MinHash bands and the values in each: two texts of similarity s share a band with probability 1 - (1 - s**4)**16, 0.9998 at 0.8.
BANDS, ROWS = 16, 4
#: Texts that a task holds and compares with each other.
SLICE = 512
#: Texts of a large group that all of its slices see: those with the most company in their bands.
GUESTS = 16
_COINS = mix(np.arange(1, BANDS * ROWS + 1, dtype=_U))[:, None]


def shingles(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def hashed(text: bytes, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different shingles; none without words."""
    words = text.lower().split()
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(words, n)), _U)) if words else np.zeros(0, _U)


def signature(hashes: np.ndarray) -> tuple[int, np.ndarray, int]:
    """The SimHash of some different shingles, a key of each band of their MinHash values, and one bit of each value."""
    least, ones = np.full(BANDS * ROWS, ~_U(0)), np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        x = (part ^ _COINS) * _U(0xD6E8FEB86659FD93)
        least = np.minimum(least, ((x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)).min(axis=1))
    simhash = int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")
    keys = np.arange(BANDS, dtype=_U)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix(keys ^ column)
    return simhash, keys, int.from_bytes(np.packbits((least >> _U(40)) & _U(1) == 1).tobytes(), "big")


class _Common:
    """How many hashes each of some sorted sets has in common with the others, by lists of the sets that hold a hash."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(self.n), [len(s) for s in sets])
        order = np.argsort(hashes, kind="stable")
        hashes, self.owner = hashes[order], owner[order]
        new = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.append(self.first, len(hashes)))
        place = np.cumsum(new) - 1
        shared = np.flatnonzero(self.count[place] > 1)
        shared = shared[np.argsort(self.owner[shared], kind="stable")]
        self.place, self.bounds = place[shared], np.searchsorted(self.owner[shared], np.arange(self.n + 1))

    def __getitem__(self, i: int) -> np.ndarray:
        place = self.place[self.bounds[i] : self.bounds[i + 1]]
        count = self.count[place]
        at = np.arange(count.sum()) + np.repeat(self.first[place] - np.cumsum(count) + count, count)
        return np.bincount(self.owner[at], minlength=self.n)


def _joined(known: np.ndarray, side: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], need: int, similarity: float) -> list[tuple[int, int]]:
    """Verified links of some texts that connect whatever their similar pairs connect. Texts of equal ``known`` are connected already.

    All pairs that agree in ``need`` sketch bits are taken but those that are connected by then; of texts on two sides
    only pairs across. From each text that is reached, those not yet reached are compared with it all at once.
    """
    size, common = np.array([len(s) for s in sets]), _Common(sets)
    same = known[:, None] == known
    fit = (np.bitwise_count(sketch[:, None] ^ sketch) <= 64 - need) & (np.minimum(size[:, None], size) >= similarity * np.maximum(size[:, None], size)) & ~same
    if side.any():
        fit &= side[:, None] != side
    reached, out = np.zeros(len(sets), bool), []
    for first in range(len(sets)):
        turn = [] if reached[first] else [first]
        reached[first] = True
        while turn:
            i = turn.pop()
            near = np.flatnonzero(fit[i] & ~reached)
            if len(near):
                both = common[i][near]
                near = near[both >= similarity * (size[i] + size[near] - both)]
                out += [(i, j) for j in near.tolist()]
                reached[near] = True
            along = np.flatnonzero(same[i] & ~reached)
            reached[along] = True
            turn += [*near.tolist(), *along.tolist()]
    return out


def _verified(rows: DataFrame, shingle: int, need: int, similarity: float) -> DataFrame:
    """Links (a, b) within the tasks of rows (task, node, known, side, sketch, text), by the exact similarity of shingle sets."""

    def run(batches):
        at, held = None, []

        def close():
            if len(held) < 2:
                return
            node, known, side, sketch, sets = zip(*held)
            node = np.array(node, np.int64)
            found = np.array(_joined(np.array(known, np.int64), np.array(side), np.array(sketch, np.int64).view(_U), list(sets), need, similarity), np.int64).reshape(-1, 2)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], names=["a", "b"])

        for b in batches:
            for task, node, known, side, sketch, text in zip(*(c.to_pylist() for c in b.columns[:5]), b.column(5).cast(pa.binary()).to_pylist()):
                if task != at:
                    yield from close()
                    at, held = task, []
                held.append((node, known, side, sketch, hashed(text, shingle)))
        yield from close()

    task = F.concat_ws(" ", "root", "slice", "other").alias("task")
    dealt = rows.select(task, "node", "known", "side", "sketch", "text").repartition(partitions(rows, 4), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(run, "a long, b long")


def _part(column: str, parts: str):
    return F.pmod(F.xxhash64(F.col(column), F.lit(SEED)), F.col(parts)).cast("int")


def _every(parts: str):
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR["shingle"], similarity: float = NEAR["similarity"], need: int = NEAR["need"], group: int = GROUP, part: int = SLICE) -> DataFrame:
    """(node, stays): the number of each different text that has near copies, and whether it's the one of its group that stays.

    docs needs ``node`` (see numbered()). Two indexes put texts in one group, loosely: the one-wildcard variants of their
    SimHash, which find up to three differing bits, and bands of the MinHash values of the same shingles, which find
    what a similarity of 0.8 moves further: in bands of up to ``group`` texts by their sketches, in larger ones all.
    Within a group the exact similarity of shingle sets links texts. A group of up to
    ``part`` texts is compared by one task. A larger one is dealt into slices, which are linked within and to common guests;
    then each text outside the group's largest linked set is compared with all of the group. So no task holds more than
    two slices, and every pair of a group is compared or connected by links that were.
    Of linked texts the one with the smallest id stays (the smallest number where ids are equal or null). Texts without words
    are copies of each other only if equal.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    named = docs.select("node", F.col(f"`{id_col}`").alias("id"), text.alias("text"))

    def sign(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                signed = [(n, *signature(h)) for n, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()) if len(h := hashed(t, shingle))]
                node, fp, keys, sketch = zip(*signed) if signed else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.array(fp, _U).view(np.int64)), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())), pa.array(np.array(sketch, _U).view(np.int64))], names=["node", "fp", "keys", "sketch"])

    signed = named.select("node", "text").mapInArrow(sign, "node long, fp long, keys array<long>, sketch long")
    signed = stored(signed.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    close = linked_fingerprints(signed, "node")
    keyed = signed.select("node", "sketch", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1")
    members = stored(keyed.join(shared, "key"))
    few = members.filter(F.col("n") <= group).select("key", F.lit(0).cast("long").alias("fp"), "node", "sketch").repartition(partitions(docs), "key").sortWithinPartitions("key").mapInArrow(_grouped(BITS, need, group, None), _OUT)
    many = members.filter((F.col("n") > group) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    loose = components(few.select("a", "b").unionByName(many).unionByName(close))
    parts = F.ceil(F.col("size") / F.lit(part)).cast("int").alias("p")
    sizes = loose.groupBy("root").agg(F.count("*").alias("size")).select("root", parts)
    placed = kept(loose.join(sizes, "root").join(signed.select("node", "sketch"), "node").select("root", "node", "sketch", "p", _part("node", "p").alias("slice")))
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(placed, "node"))

    def pick(batches):
        for b in batches:
            yield b.filter(pa.array(marked(wanted.value, b.column(0).to_numpy(zero_copy_only=False))))

    body = named.select("node", "text").mapInArrow(pick, "node long, text string").groupBy("node").agg(F.first("text").alias("text"))
    body = stored(body.join(placed.select("node"), "node", "left_semi"))

    def check(rows):
        return kept(_verified(rows.join(body, "node"), shingle, need, similarity))

    large = placed.filter("p > 1")
    company = large.join(members.groupBy("node").agg(F.sum("n").alias("company")), "node")
    best = company.groupBy("root", "slice").agg(F.max_by(F.struct("node", "sketch", "p"), F.struct("company", "node")).alias("best"), F.max("company").alias("company"))
    first = Window.partitionBy("root").orderBy(F.desc("company"), "slice")
    guests = best.withColumn("turn", F.row_number().over(first)).filter(F.col("turn") <= GUESTS).select("root", "best.*", F.col("slice").alias("home")).select("root", "node", "sketch", _every("p").alias("slice"), "home").filter("slice <> home").drop("home")
    rows = placed.select("root", "node", "sketch", "slice").unionByName(guests)
    edges = check(rows.withColumns({"known": F.col("node"), "side": F.lit(0), "other": F.lit(0)}))
    if not large.isEmpty():
        sets = components(edges).withColumnRenamed("root", "known")
        large = kept(large.join(sets, "node", "left").withColumn("known", F.coalesce("known", "node")))
        most = large.groupBy("root", "known").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("known", F.struct("n", "known")).alias("most"))
        rest = kept(large.join(most, "root").filter("known <> most").drop("most"))
        q = rest.groupBy("root").agg(F.count("*").alias("size")).select("root", parts.alias("q"))
        left = rest.join(q, "root").select("root", "node", "known", "sketch", _every("p").alias("slice"), _part("node", "q").alias("other"), F.lit(0).alias("side"))
        right = large.join(q, "root").select("root", "node", "known", "sketch", "slice", _every("q").alias("other"), F.lit(1).alias("side"))
        edges = edges.unionByName(check(left.unionByName(right)))
    roots = kept(components(edges))
    first = named.groupBy("node").agg(F.min("id").alias("id")).join(roots, "node")
    best = first.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("best"))
    return first.join(best, "root").select("node", (F.col("best.node") == F.col("node")).alias("stays"))


def numbered(docs: DataFrame, text_col: str = "text", bits: int = 64) -> DataFrame:
    """docs with ``node``, a number of its text (null: empty): equal texts have equal numbers, different ones different numbers.

    The number is a hash of ``bits`` bits. Texts that clash in it, as a second hash of 64 bits tells, get a new number of both
    hashes; there are n * n / 2**65 such numbers among n texts, so their list is broadcast.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    both = docs.withColumns({"node": F.shiftright(F.xxhash64(text), 64 - bits), "_second": F.xxhash64(text, F.lit(SEED))})
    seen = both.groupBy("node").agg(F.min("_second").alias("_low"), F.max("_second").alias("_high"))
    clashes = kept(seen.filter("_low <> _high").select("node", F.lit(True).alias("_clash")))
    if clashes.isEmpty():
        return both.drop("_second")
    both = both.join(F.broadcast(clashes), "node", "left")
    return both.withColumn("node", F.when(F.col("_clash"), F.xxhash64("node", "_second")).otherwise(F.col("node"))).select(*docs.columns, "node")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, **near) -> DataFrame:
    """docs without exact and near copies: of each group one row stays, of the smallest id; its columns are as they were.

    Equal rows are copies. Null and blank texts are copies only of texts with the same characters (null: empty).
    """
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("of"), F.col(f"`{text_col}`").alias("text"))
    own = numbered(own, "text", bits)
    copies = kept(near_copies(own, "of", **near))
    rows = own.withColumn("id", F.struct(F.col("of").isNull().alias("none"), F.col("of").alias("id")))
    stay = rows.groupBy("node").agg(F.min("id").alias("id")).join(copies.filter("not stays"), "node", "left_anti")
    one = rows.select("row", "node", "id").join(stay, ["node", "id"])
    # rows of equal text and id: the first of their few
    turn = Window.partitionBy("node", "id").orderBy(F.xxhash64("row"))
    return one.withColumn("turn", F.row_number().over(turn)).filter("turn = 1").select("row.*")
