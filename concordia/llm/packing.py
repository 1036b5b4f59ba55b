"""Best-fit packing of token sequences, improved by swaps.

Lengths are small whole numbers, so a packing is planned over how many pieces there are of each length:
bins of equal content are one pattern with a multiplicity. Best fit makes the first plan, whose size depends on the
capacity, not on the corpus; the local search then empties bins of it. Pieces find their places by their rank among those
of their length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

CAPACITY = 2048
SALTS = 64
#: Steps of the local search, patterns that a plan may have after it, and patterns of one room whose pairs are tried.
STEPS = 50_000
PATTERNS = 20_000
PAIRS = 16
_CACHE = 200_000
_loaded: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters and digits of the first 256 code points, lower case; as the tokenizer's own pattern parts them.
_PARTS = re.compile("[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^a-z0-9\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00df-\u00f6\u00f8-\u00ff]+")
#: Words of which every character is its own normal form; apostrophes may part a word in other ways, and <| begins special tokens.
_PLAIN = re.compile("(?!.*<\\|)[!-&(-~\u00a1-\u00ff]+")


def _byte_signs() -> list[str]:
    """The sign that byte-level vocabularies use for each byte: itself if it prints, else the next free one from 256 on."""
    out, free = [], 256
    for b in range(256):
        prints = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
        out.append(chr(b) if prints else chr(free))
        free += not prints
    return out


class Words:
    """Token ids (packed) of a text. This tokenizer never joins what white space parts, so words are encoded once and remembered.

    A word of plain Latin characters is cut into letters, single digits and signs here, and only a part that is new goes
    through the tokenizer's model; any other word goes through the whole tokenizer. Both memories are bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.signs = _byte_signs()
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        text = "".join([self.signs[b] for b in part.encode()])
        packed = self.parts[part] = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
        return packed

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if _PLAIN.fullmatch(word):
            get = self.parts.get
            return b"".join([get(p) or self._part(p) for p in _PARTS.findall(word.lower())])
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, words: list[bytes]) -> bytes:
        if len(self.known) > _CACHE:
            self.known.clear()
        if len(self.parts) > _CACHE:
            self.parts.clear()
        known, out = self.known, []
        for w in words:
            packed = known.get(w)
            if packed is None:
                packed = known[w] = self._word(w)
            out.append(packed)
        return b"".join(out)


def words_of(path: str) -> Words:
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every row's tokens and end_id, cut into pieces of at most capacity.

    Null and empty texts have end_id alone. Whole texts are encoded; equal rows have equal pieces, each its own.
    """
    path = path or tokenizer_path()
    stop = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = words_of(path)
        for b in batches:
            keys, text = b.column(0), b.column(1).cast(pa.binary())
            for i in range(0, b.num_rows, 64):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for r, raw in enumerate(text.slice(i, 64).to_pylist(), i):
                    packed = words.ids((raw or b"").split()) + stop
                    for p, at in enumerate(range(0, len(packed), 4 * capacity)):
                        part = packed[at : at + 4 * capacity]
                        rows.append(r)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        ids.append(part)
                cols = [keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(ids, pa.binary())] if with_ids else [])], names=["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Bins as {lengths, longest first: how many}: the longest first, each into the fullest bin that still takes it."""
    rooms: dict[int, Counter] = {}  # by room left
    open_rooms: list[int] = []

    def put(bins: tuple[int, ...], n: int) -> None:
        room = capacity - sum(bins)
        if room not in rooms:
            rooms[room] = Counter()
            insort(open_rooms, room)
        rooms[room][bins] += n

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(open_rooms, size)
            if at == len(open_rooms):
                fits = capacity // size
                if n >= fits:
                    put((size,) * fits, n // fits)
                if n % fits:
                    put((size,) * (n % fits), 1)
                break
            room = open_rooms[at]
            bins, m = next(iter(rooms[room].items()))
            fits = min(room // size, n)
            q = min(m, n // fits)
            rooms[room][bins] -= q
            if not rooms[room][bins]:
                del rooms[room][bins]
                if not rooms[room]:
                    del rooms[room]
                    open_rooms.pop(at)
            put(bins + (size,) * fits, q)
            n -= q * fits
    out: Counter = Counter()
    for x in rooms.values():
        out.update(x)
    return out


class _Underfull:
    """The bins of a plan that have room, as patterns with multiplicities, found by what they hold."""

    def __init__(self, plan: Counter, capacity: int):
        self.plan, self.capacity = plan, capacity
        self.holding: dict[int, dict[int, dict]] = {}  # by size, by room: the patterns, in order of entry
        self.rooms: dict[int, dict] = {}  # by room
        self.queue: list = []  # (fill, pattern), least full first
        for bins in sorted(plan):
            self._enter(bins)

    def _enter(self, bins: tuple[int, ...]) -> None:
        room = self.capacity - sum(bins)
        if room:
            self.rooms.setdefault(room, {})[bins] = None
            for size in set(bins):
                self.holding.setdefault(size, {}).setdefault(room, {})[bins] = None
            heappush(self.queue, (sum(bins), bins))

    def _leave(self, bins: tuple[int, ...]) -> None:
        room = self.capacity - sum(bins)
        if room:
            for by, size in [(self.rooms, None), *((self.holding[x], x) for x in set(bins))]:
                del by[room][bins]
                if not by[room]:
                    del by[room]
                    if size is not None and not by:
                        del self.holding[size]

    def add(self, bins: tuple[int, ...], n: int) -> None:
        if not bins or not n:
            return
        if not self.plan[bins]:
            self._enter(bins)
        self.plan[bins] += n
        if not self.plan[bins]:
            del self.plan[bins]
            self._leave(bins)

    def least(self):
        """The least full pattern, or None."""
        while self.queue and not self.plan.get(self.queue[0][1]):
            heappop(self.queue)
        return self.queue[0][1] if self.queue else None

    def _other(self, patterns: dict, giver: tuple[int, ...]):
        """A pattern at least as full as the giver; the giver's own if it has two bins."""
        for bins in patterns:
            if sum(bins) >= sum(giver) and (bins != giver or self.plan[giver] > 1):
                return bins
        return None

    def exchange(self, giver: tuple[int, ...]):
        """(bins, out of the giver, out of the bins): what fills another bin most of all a giver's moves, one-for-one and two-for-one exchanges; None if there's none.

        What a bin gains is at most its room: so of all rooms, and of what is left of a piece without what is taken back,
        the largest gain is looked up. Pairs are only tried where neither a move nor one piece fills a bin to the brim.
        """
        best, gain, most = None, 0, max(self.rooms)
        for x in sorted(set(giver), reverse=True):
            for wanted in range(min(x, most), gain, -1):
                by_room = self.rooms if wanted == x else self.holding.get(x - wanted, {})
                if bins := next((b for room in by_room if room >= wanted and (b := self._other(by_room[room], giver))), None):
                    best, gain = (bins, (x,), () if wanted == x else (x - wanted,)), wanted
                    break
        if best is None or self.capacity - sum(best[0]) > gain:
            for x in sorted(set(giver), reverse=True):
                for room, patterns in self.rooms.items():
                    for bins in islice(patterns, PAIRS):
                        if sum(bins) >= sum(giver) and (bins != giver or self.plan[giver] > 1):
                            # to the brim; if nothing else was found, as far as it goes
                            for wanted in range(min(room, x), gain if best is None else max(gain, room - 1), -1):
                                if pair := _pair(bins, x - wanted):
                                    best, gain = (bins, (x,), pair), wanted
                                    break
        return best


def _pair(bins: tuple[int, ...], total: int) -> tuple[int, int] | None:
    """Two of the bins' pieces that have a total length."""
    sizes = set(bins)
    return next(((y, total - y) for y in sizes if total - y in sizes and (2 * y != total or bins.count(y) > 1)), None)


def _swap(bins: tuple[int, ...], out: tuple[int, ...], into: tuple[int, ...]) -> tuple[int, ...]:
    left = [*bins]
    for x in out:
        left.remove(x)
    return tuple(sorted([*left, *into], reverse=True))


def improve(plan: Counter, capacity: int, steps: int = STEPS, patterns: int = PATTERNS) -> Counter:
    """Empties the least full bins by moves, one-for-one and two-for-one exchanges with other underfull bins.

    The least full bin gives, in each step by the exchange that gains most, what makes a fuller bin fuller: so the sum of
    squared fills grows with each, and the search ends. A step takes as many bins of both patterns at once as
    there are. It also ends where the tokens need as many bins as there are, after ``steps`` steps, or at
    ``patterns`` patterns: the plan is valid after every step, so this only leaves bins that might have been emptied.
    """
    plan = Counter({b: n for b, n in plan.items() if n})
    least, bins = -(-sum(sum(b) * n for b, n in plan.items()) // capacity), sum(plan.values())
    state, stuck = _Underfull(plan, capacity), []
    for _ in range(steps):
        giver = state.least()
        if bins <= least or giver is None or len(plan) >= patterns:
            break
        found = state.exchange(giver)
        if found is None:
            heappop(state.queue)  # nothing that it holds fits elsewhere; it's looked at again when the search has changed other bins
            stuck.append(giver)
            if len(stuck) > 64:
                break
            continue
        for x in stuck:
            heappush(state.queue, (sum(x), x))
        stuck = []
        other, out, back = found
        n = plan[giver] // 2 if other == giver else min(plan[giver], plan[other])
        state.add(giver, -n)
        state.add(other, -n)
        left = _swap(giver, out, back)
        state.add(left, n)
        state.add(_swap(other, back, out), n)
        bins -= 0 if left else n
    return plan


def slots(plan: Counter) -> dict[str, np.ndarray]:
    """For each length, in order of rank: the first rank of a slot, the number of its first bin, and its offset there."""
    base, next_rank, rows = 0, Counter(), []
    for bins, n in sorted(plan.items(), key=lambda x: (-sum(x[0]), x[0])):
        at = 0
        for size in bins:
            rows.append((size, next_rank[size], base, at))
            next_rank[size] += n
            at += size
        base += n
    size, first, base_of, at = (np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 4
    return {"key": (size << 48) | first, "first": first, "base": base_of, "offset": at}


def pack(cut: DataFrame, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """cut (from pieces()) with sequence_id and offset: a packing into few sequences of at most capacity, gapless from 0.

    No pieces, no rows; a column of cut that isn't pieces()' own is passed on, but not one named salt, rank, ahead or n.
    Only the number of pieces of each length comes to the driver, at most capacity numbers; the plan's slots, a number that
    depends on the capacity and PATTERNS and not on the corpus, are broadcast. Pieces of one length are
    interchangeable; their ranks are counted in slices of (length, hash), so a length that a third of them has is no
    more work for a task. Equal rows get places of their own.
    """
    salt = F.pmod(F.xxhash64("id", "piece", "start"), F.lit(SALTS)).cast("int")
    cut = kept(cut)
    salted = cut.withColumn("salt", salt)
    counted = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = kept(counted.select("length", "salt", ahead.alias("ahead"), "n"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = cut.sparkSession.sparkContext.broadcast(slots(improve(best_fit(counts, capacity), capacity, steps)))
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(counted.drop("n")), ["length", "salt"])
    ranked = ranked.select(*cut.columns, (F.col("rank") + F.col("ahead")).alias("rank"))

    def place(batches):
        where = plan.value
        for b in batches:
            size, rank = (b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(where["key"], (size.astype(np.int64) << 48) | rank, "right") - 1
            sequence = where["base"][at] + rank - where["first"][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(where["offset"][at])], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
