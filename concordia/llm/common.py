"""Helpers that the operators of this package share: checkpoints, Arrow text, hashes, anchors.

Word separators are the six ASCII white-space bytes 0x20 and 0x09-0x0D throughout, which is
what ``bytes.split()`` and the pattern ``[^\\x20\\x09-\\x0D]+`` use.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; longer documents are taken alone.
CHUNK = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, _U)
_inverse = np.ones(1, _U)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame, times: int = 1) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * times


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only in local mode, and where it is unset, a temporary folder takes its place."""
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        home = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(home)
    return home.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, so that its lineage is cut and lost executors do no harm."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on each other."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        m = max(n, CHUNK + 1)
        p, q = np.full(m, _P, _U), np.full(m, pow(_P, -1, 2**64), _U)
        p[0] = q[0] = 1
        _powers, _inverse = np.cumprod(p), np.cumprod(q)
    return _powers[:n], _inverse[:n]


def prefix_hash(units: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() takes the hash of any run of units."""
    out = np.zeros(len(units) + 1, _U)
    np.cumsum(units * powers(len(units))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end): equal runs have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(_U))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset of each row in them (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Row ranges (i, j) of at most limit bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of some texts, and the index of each text's first word (one more at the end).

    data holds the texts one after another, bounds where each begins and, last, where they end.
    """
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(_BYTE[data]), starts, ends)


def byte_units(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def anchored(prefix: np.ndarray, bounds: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """Cuts the windows of some texts into segments: runs of windows with the same smallest k-gram, their anchor.

    Two equal windows have the same anchor, wherever they stand, so whatever repeats can be found among segments
    of one anchor. prefix: of all units; bounds: the first unit of each text, and the end. A segment is
    [start, end) in units and holds its windows whole. inner: its anchor stands in it more than once, so that
    equal windows may lie within the segment itself.
    """
    none = {c: np.zeros(0, t) for c, t in (("row", np.int64), ("start", np.int64), ("end", np.int64), ("anchor", _U), ("segment", _U), ("inner", bool))}
    n = len(prefix) - 1
    if n < length:
        return none
    sizes = np.diff(bounds)
    rows = np.flatnonzero(sizes >= length)
    if not len(rows):
        return none
    grams = span_hash(prefix, np.arange(n - k + 1), np.arange(k, n + 1))
    wide = length - k + 1
    least = sliding_min(grams, wide)
    runs_of = sizes[rows] - length + 1  # windows of each text
    row = np.repeat(rows, runs_of)
    at = np.arange(len(row)) - np.repeat(np.cumsum(runs_of) - runs_of, runs_of) + bounds[row]
    low = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    finish = np.append(begin[1:], len(at)) - 1
    start, end, anchor = at[begin], at[finish] + length, low[begin]
    # Where the anchors stand: a gram that is the least of some window that holds it.
    chosen = _chosen(grams, least, wide)
    values, rank = np.unique(grams[chosen], return_inverse=True)
    span = np.int64(n + 1)
    keys = np.sort(rank.astype(np.int64) * span + chosen)
    own = np.searchsorted(values, anchor).astype(np.int64) * span
    count = np.searchsorted(keys, own + end - k, "right") - np.searchsorted(keys, own + start, "left")
    # smallest hashes are small numbers; mixed, they are spread over all
    return {"row": row[begin], "start": start, "end": end, "anchor": mix(anchor), "segment": span_hash(prefix, start, end), "inner": count > 1}


def _chosen(grams: np.ndarray, least: np.ndarray, wide: int) -> np.ndarray:
    """Positions of the grams that are the least of a window that holds them."""
    pad = np.zeros(len(grams) + wide - 1, np.uint64)
    pad[wide - 1 : wide - 1 + len(least)] = least
    # the largest of the least values of the windows around a gram, as the smallest of their complements
    return np.flatnonzero(~sliding_min(~pad, wide) == grams)


def bitmap(df: DataFrame, column: str, most: int = 27) -> np.ndarray:
    """A map of bits that has a one wherever a 64-bit value of the column falls by its top bits.

    It has 32 bits a row, up to 2**most: at most 2**most / 8 bytes (16 MB) reach the driver and, broadcast, the executors,
    whatever the input. As more rows share it the map fills and sorts out less, but never hides a value. Each slice of it
    is made in one task.
    """
    bits = min(most, max(16, (32 * df.count()).bit_length()))
    low = max(0, bits - 10)

    def slices(batches):
        own: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> _U(64 - bits)
            for s in np.unique(at >> _U(low)):
                part = own.setdefault(int(s), np.zeros(1 << low, bool))
                part[(at[at >> _U(low) == s] & _U((1 << low) - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_pydict({"slice": pa.array([*own], pa.int32()), "map": pa.array([np.packbits(x).tobytes() for x in own.values()], pa.binary())})

    out = np.zeros((1 << (bits - low), (1 << low) // 8), np.uint8)
    c = F.col(column)
    for r in df.select(c).repartition(F.shiftrightunsigned(c, 64 - bits + low)).mapInArrow(slices, "slice int, map binary").toLocalIterator():
        out[r["slice"]] = np.frombuffer(r["map"], np.uint8)
    return out.ravel()


def marked(bits_of: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether bitmap() may hold each value."""
    shift = 64 - (len(bits_of) * 8).bit_length() + 1
    at = (values.view(np.uint64) >> _U(shift)).astype(np.int64)
    return (bits_of[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of some runs [start, end), as sorted runs that don't touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return starts[begin], reach[np.append(begin[1:], len(starts)) - 1]


def folded(apart: bytes, only: bytes | None = None) -> bytes:
    """A table for bytes.translate(): A-Z lower-cased, and a blank for each byte of ``apart``, or not in ``only``."""
    out = bytearray(range(256))
    for i in range(65, 91):
        out[i] += 32
    for i in range(256):
        if i in apart or only is not None and i not in only:
            out[i] = 32
    return bytes(out)


def term_counts(rows: DataFrame, keys: list[str], fold: bytes, most: int = 1 << 18) -> DataFrame:
    """(*keys, term, n, docs): how often a term stands in all texts of a group, and in how many of them.

    rows has the keys, strings that are never null, and ``text``; null is empty. ``fold`` is folded()'s table; terms are what
    is left between white space. A task counts up to ``most`` entries before it hands them on, so a term that is in every text,
    or a group that has most of them, is a few rows a task when it's shuffled.
    """
    names = [*keys, "term", "n", "docs"]

    def handed(held):
        for group, (n, docs) in held.items():
            columns = [*(pa.array([g] * len(n), pa.string()) for g in group), pa.array([*n], pa.binary()).cast(pa.string()), pa.array([*n.values()], pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def count(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for b in batches:
            groups = zip(*(b.column(i).to_pylist() for i in range(len(keys))))
            for i, (group, text) in enumerate(zip(groups, b.column(len(keys)).cast(pa.binary()))):
                found = (text.as_py() or b"").translate(fold).split()
                n, docs = held.setdefault(group, (Counter(), Counter()))
                n.update(found)
                docs.update(set(found))
                if i % 64 == 0 and sum(len(x) for x, _ in held.values()) > most:
                    yield from handed(held)
                    held = {}
        yield from handed(held)

    out = ", ".join([*(f"{k} string" for k in keys), "term string", "n long", "docs long"])
    counted = rows.select(*keys, "text").mapInArrow(count, out).groupBy(*keys, "term")
    return counted.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def looked_up(rows: DataFrame, key: str, found: DataFrame, most: int = 10_000) -> DataFrame:
    """rows left-joined to ``found``, which has each key once.

    Keys that stand in over one of ``most`` rows each would be a task's whole share: of them there are at most ``most``,
    and what was found of them is broadcast. The others meet by a shuffled join. A null key finds nothing.
    """
    n = rows.count()
    hot = kept(rows.groupBy(key).agg(F.count("*").alias("_n")).filter((F.col("_n") * most > n) & F.col(key).isNotNull()).select(key))
    some = F.broadcast(found.join(F.broadcast(hot), key, "left_semi").withColumn("_hot", F.lit(True)))
    names = [c for c in found.columns if c != key]
    out = rows.join(some, key, "left")
    hit, rest = out.filter("_hot or " + f"`{key}` is null"), out.filter(f"_hot is null and `{key}` is not null").drop(*names, "_hot")
    return hit.drop("_hot").unionByName(rest.join(found, key, "left"))


_tables: set[str] = set()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _forget(spark: SparkSession, home: str) -> None:
    """Deletes the folder of this application's tables, if its session still runs."""
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(home)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df, written as a Parquet table in the shared checkpoint folder; for what is larger than a few rows a document.

    The tables of an application stand in one folder, which is deleted when the driver's Python ends.
    """
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    if home not in _tables:
        _tables.add(home)
        atexit.register(_forget, spark, home)
    path = f"{home}/{uuid.uuid4().hex}"
    # the shuffles that made it are not read again: they go with the write, not when the driver collects its garbage
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
