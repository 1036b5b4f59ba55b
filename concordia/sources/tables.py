"""Readers, probes and sinks for source tables."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header, by declared types: blank or unusable text becomes null."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return raw.select(*(F.nullif(F.trim(F.col(f.name)), F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, seconds: int = 3, **options) -> DataFrame:
    """A whole table of a database, read in ranges of its key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties={"queryTimeout": str(seconds), **options})


def describe(df: DataFrame, samples: int = 20) -> DataFrame:
    """One row per column: name, type, position and up to ``samples`` of its smallest values, as text. All rows are read.

    Distinct values are ranked in hash slices first, so that no task sorts all values of a column.
    """
    plain = [(i, f) for i, f in enumerate(df.schema) if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    names = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema)], "column string, type string, position int")
    if not plain:
        return names.withColumn("samples", F.array().cast("array<string>"))
    cells = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("position"), F.col(f"`{f.name}`").cast("string").alias("value")) for i, f in plain))))
    values = cells.filter("value is not null").distinct().withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(64)))
    for by in (("position", "slice"), ("position",)):
        values = values.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("value"))).filter(F.col("_at") <= samples).drop("_at")
    found = values.groupBy("position").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    return names.join(found, "position", "left").select("column", "type", "position", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def probe(df: DataFrame) -> str:
    """OK if a row can be read, else ERROR: a source that fails must not fail the question."""
    try:
        df.limit(1).collect()
        return "OK"
    except Exception:
        return "ERROR"


#: What the message of a source that isn't there has in it; anything else that fails is an ERROR.
DOWN = ("Connection refused", "ConnectException", "ConnectionRefused", "UnknownHost", "NoRouteToHost", "ConnectionResetError", "FileNotFound", "FILE_NOT_EXIST", "PATH_NOT_FOUND", "unable to open database")


def probes(sources: dict[str, DataFrame | Callable[[], DataFrame]], seconds: float) -> dict[str, str]:
    """Whether a row can be read of each source, all at once: OK, DOWN (nobody there), ERROR, or TIMEOUT after ``seconds``.

    A source is a DataFrame, or a function that makes one, as that may fail or hang too. Jobs of sources that are late
    are cancelled; the caller waits no longer than the deadline.
    """
    out: dict[str, str] = {}
    session = SparkSession.getActiveSession()
    tag = f"probe-{uuid.uuid4().hex}"

    def run(name: str, source) -> None:
        try:
            if session is not None:
                session.addTag(f"{tag}-{name}")
            df = source() if callable(source) and not isinstance(source, DataFrame) else source
            if df is not None:
                df.limit(1).collect()
            out.setdefault(name, "OK")
        except Exception as e:
            text = f"{type(e).__name__} {e}"
            out.setdefault(name, "DOWN" if any(x in text for x in DOWN) else "ERROR")

    from pyspark import InheritableThread

    threads = {n: InheritableThread(target=run, args=(n, s), daemon=True) if session is not None else threading.Thread(target=run, args=(n, s), daemon=True) for n, s in sources.items()}
    for t in threads.values():
        t.start()
    end = time.monotonic() + seconds
    for n, t in threads.items():
        t.join(max(0.0, end - time.monotonic()))
        if t.is_alive():
            out.setdefault(n, "TIMEOUT")
            if session is not None:
                session.interruptTag(f"{tag}-{n}")
    return {n: out[n] for n in sources}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with rows of new in place of those of equal key; the last by order wins among new ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), *([F.desc_nulls_last(order)] if order else []))
    return both.withColumn("_at", F.row_number().over(last)).filter("_at = 1").drop("_new", "_at")


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Columns get new values where a condition is true."""
    return df.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(~F.coalesce(where, F.lit(False)))


def append(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def delete_orphans(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    return parents.join(children.select(F.col(child_key).alias("_k")).distinct(), F.col(parent_key) == F.col("_k"), "left_semi")


def patch(df: DataFrame, changes: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """df with logged changes (record_id, field, before_value, after_value) in place, or taken back.

    A change only takes where the row still has the value it was made against; the newest change of a field counts.
    """
    was, becomes = ("after_value", "before_value") if undo else ("before_value", "after_value")
    newest = Window.partitionBy("record_id", "field").orderBy(F.desc("log_id"))
    last = changes.withColumn("_at", F.row_number().over(newest)).filter("_at = 1")
    byfield = last.groupBy(F.col("record_id").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct(F.col(was).alias("was"), F.col(becomes).alias("becomes"))))).alias("_change"))
    out = df.join(byfield, F.col(key).cast("string") == F.col("_id").cast("string"), "left")

    def value(f: T.StructField) -> Column:
        change = F.try_element_at(F.col("_change"), F.lit(f.name))
        return F.when(change.isNotNull() & F.col(f.name).cast("string").eqNullSafe(change["was"]), change["becomes"].try_cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)

    return out.select(*(value(f) if f.name != key else F.col(f.name) for f in df.schema))
