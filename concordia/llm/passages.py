"""Removal of passages that repeat: byte strings anywhere (by merged Burrows-Wheeler transforms), word windows of earlier documents (by suffix automata).

Both cut each text into segments of windows that share an anchor, their smallest k-gram (see common.anchored): equal windows
share it, wherever they stand. So
1. anchors are counted. Most stand once and are done with: that is a filter, which loses nothing;
2. segments of the others are dealt out by anchor: of each different one (by 64 bits of hash besides the anchor's 64) two
   occurrences with their text, and how many there are. A task takes some whole anchors at a time, in blocks of bounded
   size, and finds which windows repeat: op2 merges the transforms of the block's segments, op3 builds the suffix automaton
   of the reference, the segments' occurrences in the texts of smallest rank, and streams the others through it. Every segment
   meets the one block that can hold its matches, instead of all of them;
3. an anchor with more different segments than a block should hold (the edge of a passage that very many documents quote) is
   dealt out finer: its windows are parted by how far from their start the anchor stands, which equal windows share too,
   and at last by what they are. What is found, and how, doesn't depend on how fine the parts are;
4. found runs go back to all occurrences of their segment by a join, of which Spark splits what is skewed, are gathered by
   text and removed.

Texts are wide and shuffles cost disk: bodies are written once and dealt out once, by anchor. What the map of anchors
lets through though they stand once is not joined away, but stands alone in its part.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .bwt import repeated
from .common import anchored, bitmap, byte_units, chunks, covered, kept, marked, mix, partitions, prefix_hash, span_hash, stored, texts, word_hashes, words

BYTES, BYTE_GRAM = 200, 32
WORDS, WORD_GRAM = 13, 5
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes of segments that a task searches at a time, and different segments of one part that are dealt out together.
BLOCK = 1 << 15
TOGETHER = 4_000
#: Rows of an anchor that one step may hand on to be counted; of more only those with an extreme value go on.
MANY = 8


def _segments(column: pa.Array, by_words: bool, length: int, k: int):
    """(rows, segments as of anchored(), bounds of each text, bytes, word starts and ends) of some texts after others."""
    data, offsets = texts(column)
    for i, j in chunks(offsets):
        part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts = ends = None
        units, first = byte_units(part), bounds
        if by_words:
            starts, ends, first = words(part, bounds)
            units = word_hashes(part, starts, ends)
        found = anchored(prefix_hash(units), first, length, k)
        yield i, found, first, part, starts, ends


def _arrow(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], names=[*columns])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _place(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of where a segment stands, that tells its occurrences apart."""
    return mix(key.view(np.uint64) ^ mix(start.astype(np.uint64) + np.uint64(1)))


def _extremes(group: np.ndarray, *columns: np.ndarray, many: int = MANY) -> np.ndarray:
    """Rows enough for each group's least and largest values: all of those of up to ``many`` rows, else those that have such a value."""
    _, group, count = np.unique(group, return_inverse=True, return_counts=True)
    use = count[group] <= many
    crowd = np.flatnonzero(~use)
    for c in columns if len(crowd) else ():
        order = crowd[np.lexsort((c[crowd], group[crowd]))]
        new = np.append(True, group[order[1:]] != group[order[:-1]])
        use[order[new]] = use[order[np.append(new[1:], True)]] = True
    return np.flatnonzero(use)


def find(keyed: DataFrame, by_words: bool, length: int, k: int, block: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """(key, start, end) of runs to remove; keyed has key (long), rank (long) and text.

    Bytes: runs of windows that start anywhere else too. Words: of windows that start in a row of smaller rank too.
    """

    def count(batches):
        for b in batches:
            rank, key = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            for i, s, *_ in _segments(b.column(0), by_words, length, k):
                row = s["row"] + i
                # words that only texts of one rank have are nobody's copy; bytes may repeat within a segment
                mark = rank[row] if by_words else s["inner"].astype(np.int64)
                # the maps that tell places apart have fewer bits
                place = (_place(key[row], s["start"]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                use = _extremes(s["anchor"], s["segment"], mark, place)
                yield _arrow(anchor=_signed(s["anchor"][use]), segment=_signed(s["segment"][use]), mark=mark[use], place=place[use])

    source = keyed.select("text", "rank", "key")
    # nearly all anchors differ: to count them before they are dealt out would only make their rows wider
    counted = source.mapInArrow(count, "anchor long, segment long, mark long, place int").repartition("anchor").groupBy("anchor")
    counted = counted.agg(F.count("*").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"), F.min("mark").alias("least"), F.max("mark").alias("most"), F.min("place").alias("one"), F.max("place").alias("two"))
    place = [F.shiftleft(F.col(c).cast("long"), 32).alias(c) for c in ("one", "two")]
    again = stored(counted.filter("least < most" if by_words else "n > 1 or most = 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed"), *place))
    context = keyed.sparkSession.sparkContext
    maps = context.broadcast((bitmap(again, "anchor"), bitmap(again.filter("mixed"), "anchor"), bitmap(again.filter("not mixed").select(F.explode(F.array("one", "two")).alias("place")), "place")))

    def occurrences(batches):
        repeats, mixed, shown = maps.value
        for b in batches:
            rank, key = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            for i, s, first, part, starts, ends in _segments(b.column(0), by_words, length, k):
                use = np.flatnonzero(marked(repeats, s["anchor"]))
                row, start, end = s["row"][use], s["start"][use], s["end"][use]
                place = _place(key[row + i], start)
                at, to = (starts[start], ends[end - 1]) if by_words else (start, end)
                raw = part.tobytes()
                # of many equal segments some stand for all
                stands = np.zeros(len(use), bool)
                stands[_extremes(mix(s["segment"][use]) ^ s["anchor"][use], rank[row + i], _signed(place))] = True
                # where all segments of an anchor are equal, two of them show their text
                show = stands & (marked(mixed, s["anchor"][use]) | marked(shown, place))
                body = [raw[x:y] if m else None for x, y, m in zip(at.tolist(), to.tolist(), show.tolist())]
                yield _arrow(anchor=_signed(s["anchor"][use]), segment=_signed(s["segment"][use]), key=key[row + i], rank=rank[row + i], start=(start - first[row]).astype(np.int32), stands=stands, body=pa.array(body, pa.binary()))

    seen = stored(source.mapInArrow(occurrences, "anchor long, segment long, key long, rank long, start int, stands boolean, body binary"))

    def summed(rows: DataFrame) -> DataFrame:
        place = F.xxhash64("key", "start").alias("place")
        shown = F.when(F.col("body").isNotNull(), F.struct("rank", place, "body"))
        # dealt out by part, so that the segments of a part are summed, and searched, where they are
        rows = rows.repartition(partitions(rows, 2), "part").groupBy("part", "segment").agg(F.min(shown).alias("one"), F.max(shown).alias("two"), F.min("rank").alias("rank"), F.count("*").alias("n"))
        # rows equal in id and text share their places: the second occurrence is then as the first
        second = F.when(F.col("one.place") != F.col("two.place"), F.col("two.body")).when(F.col("n") > 1, F.col("one.body"))
        # of an anchor that stands once nobody may have asked for the text
        return rows.filter("one is not null").select("part", "segment", F.col("part").alias("anchor"), F.col("one.body").alias("body"), second.alias("second"), "rank")

    wide = length - k + 1
    found = _searched(seen.filter("stands").withColumnRenamed("anchor", "part"), summed, by_words, length, k, block, together, (max(2, wide // 8), 1))
    found = found.select(F.col("part").alias("anchor"), "segment", "least", "from", "to")
    runs = seen.select("anchor", "segment", "key", "rank", "start").join(found, ["anchor", "segment"])
    if by_words:
        runs = runs.filter(F.col("rank") > F.col("least"))
    return runs.select("key", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end"))


def _searched(rows: DataFrame, summed, by_words: bool, length: int, k: int, block: int, together: int, widths: tuple[int, ...]) -> DataFrame:
    """(part, segment, least, from, to): repeated runs within the segments of each part.

    rows: the segments' occurrences; summed: makes of some of them one row a segment (part, segment, anchor, body, second, rank),
    whole parts to a task.
    """
    search = _by_automaton if by_words else _by_bwt
    out = "part long, segment long, least long, from int, to int"

    def searched(rows):
        dealt = summed(rows).select("part", "segment", "body", "second", "rank").sortWithinPartitions("part")
        return dealt.mapInArrow(_blocks(search, length, block), out)

    if not widths:
        return searched(rows)
    # at most one part for each ``together`` segments
    crowds = kept(rows.select("part", "segment").distinct().groupBy("part").agg(F.count("*").alias("m")).filter(F.col("m") > together).select("part"))
    if crowds.isEmpty():
        return searched(rows)
    few = searched(rows.join(F.broadcast(crowds), "part", "left_anti"))
    cut = summed(rows.join(F.broadcast(crowds), "part", "left_semi")).select("part", "segment", "anchor", "body", "second", "rank")
    cut = stored(cut.mapInArrow(_finer(by_words, length, k, widths[0], len(widths) == 1), "part long, segment long, at int, anchor long, finer long, cut long, body binary, second binary, rank long"))

    def narrower(rows: DataFrame) -> DataFrame:
        text = F.struct("of", "at", "body", "second")
        rows = rows.repartition(partitions(rows, 2), "part").groupBy("part", "segment").agg(F.first("anchor").alias("anchor"), F.min(text).alias("one"), F.max(text).alias("two"), F.min("rank").alias("rank"))
        other = F.when((F.col("one.of") != F.col("two.of")) | (F.col("one.at") != F.col("two.at")), F.col("two.body")).otherwise(F.col("one.second"))
        return rows.select("part", "segment", "anchor", F.col("one.body").alias("body"), other.alias("second"), "rank")

    inner = cut.select(F.col("finer").alias("part"), F.col("cut").alias("segment"), F.col("segment").alias("of"), "at", "anchor", "body", "second", "rank")
    hits = _searched(inner, narrower, by_words, length, k, block, together, widths[1:])
    hits = hits.select(F.col("part").alias("finer"), F.col("segment").alias("cut"), "least", "from", "to")
    hits = cut.select("part", "segment", "at", "finer", "cut").join(hits, ["finer", "cut"])
    return few.unionByName(hits.select("part", "segment", "least", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to")).alias("to")))


def _finer(by_words: bool, length: int, k: int, width: int, alone: bool):
    """Parts the windows of crowded segments by how far from their start the anchor stands, ``width`` places in a part; alone: and by what they are."""

    def pieces(body: bytes):
        part = np.frombuffer(body, np.uint8)
        if by_words:
            starts, ends, _ = words(part, np.array([0, len(part)]))
            return word_hashes(part, starts, ends), lambda x, y: body[starts[x] : ends[y - 1]]
        return byte_units(part), lambda x, y: body[x:y]

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for part, segment, anchor, body, second, rank in zip(*(c.to_pylist() for c in b.columns)):
                units, text = pieces(body)
                other = pieces(second)[1] if second is not None else None
                prefix = prefix_hash(units)
                gram = np.arange(len(units) - k + 1)
                stands = np.flatnonzero(mix(span_hash(prefix, gram, gram + k)) == np.int64(anchor).view(np.uint64))
                window = np.arange(len(units) - length + 1)
                after = stands[np.searchsorted(stands, window)]
                place = (after - window) // width
                begin = window if alone else np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                end = np.append(begin[1:], len(window)) - 1 + length
                cut = span_hash(prefix, begin, end)
                if alone:
                    use = _needed(cut, begin, length)
                    begin, end, cut = begin[use], end[use], cut[use]
                finer = mix(np.int64(anchor).view(np.uint64) ^ mix(place[begin].astype(np.uint64) * np.uint64(width) + np.uint64(width << 20)))
                if alone:
                    finer = mix(finer ^ cut)
                for x, y, f, c in zip(begin.tolist(), end.tolist(), _signed(finer).tolist(), _signed(cut).tolist()):
                    rows.append((part, segment, x, anchor, f, c, text(x, y), other(x, y) if other else None, rank))
            names = ("part", "segment", "at", "anchor", "finer", "cut", "body", "second", "rank")
            kinds = (pa.int64(), pa.int64(), pa.int32(), *(pa.int64(),) * 3, pa.binary(), pa.binary(), pa.int64())
            yield _arrow(**{c: pa.array(v, t) for c, v, t in zip(names, zip(*rows) if rows else [()] * len(names), kinds)})

    return run


def _needed(cut: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """Which of a text's windows, equal where their hashes are, have to be kept so that equal ones cover what all of them do.

    Of a run of one character, or a short period, nearly all windows can go: what is left of each different one are the first in each
    stretch of half a window, and those after which half a window goes by without an equal one. Of two or more equal ones two stay.
    """
    half = max(1, length // 2)
    order = np.lexsort((begin, cut))
    c, at = cut[order], begin[order]
    same = c[1:] == c[:-1]
    first = np.append(True, ~same | (at[1:] // half != at[:-1] // half))
    last = np.append(~same | (at[1:] - at[:-1] > half), True)
    return np.sort(order[first | last])


def _blocks(search, length: int, block: int):
    """Hands over whole anchors, some of them at a time."""

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if size > block and rows[-1][0] != r[0]:
                    yield from search(rows, length)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[2]) + len(r[3] or b"")
        if rows:
            yield from search(rows, length)

    return run


def _found(rows, runs) -> pa.RecordBatch:
    """runs: (index in rows, least, from, to)."""
    at, least, start, end = zip(*runs) if runs else ((),) * 4
    return _arrow(part=pa.array([rows[i][0] for i in at], pa.int64()), segment=pa.array([rows[i][1] for i in at], pa.int64()), least=pa.array(least, pa.int64()), **{"from": pa.array(start, pa.int32()), "to": pa.array(end, pa.int32())})


def _by_bwt(rows, length):
    """rows: (part, segment, body, second, rank). All bodies are merged, and all seconds, which are other occurrences of their bodies."""
    strings = [r[2] for r in rows] + [r[3] for r in rows if r[3] is not None]
    yield _found(rows, [(i, 0, x, y) for i, x, y in repeated(strings, length) if i < len(rows)])


def _by_automaton(rows, length):
    """The bodies, in the texts of smallest rank, are the reference; the seconds, and bodies that have none, are streamed."""
    lists = [r[2].split() for r in rows]
    automaton = SuffixAutomaton([(w, r[4]) for w, r in zip(lists, rows)])
    runs: list[tuple] = []
    for i, (w, r) in enumerate(zip(lists, rows)):
        for at, least in automaton.windows(w if r[3] is None else r[3].split(), length):
            if runs and runs[-1][:2] == (i, least) and runs[-1][3] == at + length - 1:
                runs[-1] = (i, least, runs[-1][2], at + length)
            else:
                runs.append((i, least, at, at + length))
    yield _found(rows, runs)


def remove(docs: DataFrame, id_col: str, text_col: str, by_words: bool, length: int, k: int, carry=(), block: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """One row per row of docs: carry, n_units, n_removed, n_spans, kept_sha256 (of words: joined by one space) and kept_text (white space as it was).

    Only texts from which something may have to be removed are shuffled.
    """
    key = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))
    # a null id comes before all others
    rank = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))) if by_words else F.lit(0).cast("long")
    keyed = docs.select(key.alias("key"), rank.alias("rank"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    runs = stored(find(keyed, by_words, length, k, block, together))
    hit = docs.sparkSession.sparkContext.broadcast(bitmap(runs, "key"))
    base = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row") if carry else F.lit(None).cast("int").alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    spans = runs.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def hits(b: pa.RecordBatch, wanted: bool) -> pa.RecordBatch:
        return b.filter(pa.array(marked(hit.value, b.column(0).to_numpy(zero_copy_only=False)) == wanted))

    def pick(batches):
        for b in batches:
            yield hits(b, True)

    def rest(batches):
        """What is not hit has no runs: it needs no shuffle and is finished in the same pass."""
        yield from finish(pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows)], names=[*b.schema.names, "spans"]) for b in (hits(x, False) for x in batches))

    def finish(batches):
        for b in batches:
            n, gone, count, digest, left = [], [], [], [], []
            for text, found in zip(b.column(2).cast(pa.binary()), b.column(3)):
                raw = text.as_py()
                found = found.values if found.is_valid else None
                starts, ends = covered(*(found.field(c).to_numpy() for c in ("start", "end"))) if found is not None else ((), ())
                units = raw.split() if by_words else raw
                parts, at = [], 0
                for x, y in zip(starts, ends):
                    parts.append(units[at:x])
                    at = y
                parts.append(units[at:])
                rest = b" ".join(w for p in parts for w in p) if by_words else b"".join(parts)
                n.append(len(units))
                gone.append(int(sum(e - s for s, e in zip(starts, ends))))
                count.append(len(starts))
                digest.append(hashlib.sha256(rest).hexdigest())
                if by_words and len(starts):
                    # the text as it was between what is removed, with its own white space
                    at = [m.span() for m in _WORD.finditer(raw)]
                    cuts = [0, *(x for s, e in zip(starts, ends) for x in (at[s][0], at[e][0] if e < len(at) else len(raw))), len(raw)]
                    rest = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2]))
                left.append((rest if len(starts) else raw).decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.string())], names=["row", "n_units", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    out = f"row {base.schema['row'].dataType.simpleString()}, n_units long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    dirty = base.mapInArrow(pick, base.schema).join(spans, "key", "left").select("key", "row", "text", "spans")
    return base.mapInArrow(rest, out).unionByName(dirty.mapInArrow(finish, out))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = BYTES, k: int = BYTE_GRAM, carry=("doc_id",), **sizes) -> DataFrame:
    """Removes each byte that a string of ``length`` bytes covers which also starts anywhere else, in this text or another.

    Texts are UTF-8 bytes, null is empty; strings are judged on the input and don't cross texts. Equal rows repeat each
    other. kept_text leaves out bytes of characters that were cut in two; kept_sha256 is of all kept bytes.
    """
    return remove(docs, id_col, text_col, False, length, k, carry, **sizes)


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WORDS, k: int = WORD_GRAM, carry=("doc_id",), **sizes) -> DataFrame:
    """Removes each word that a window of ``length`` words covers which also starts in a row of a smaller id.

    Null and blank texts have no words; rows of equal ids don't remove each other's words; a null id is smaller than
    all others. Windows are judged on the input.
    """
    return remove(docs, id_col, text_col, True, length, k, carry, **sizes)
