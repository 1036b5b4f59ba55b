"""Append-only logs with typed columns: lists and maps are stored as JSON, days as folders, and entries read newest first.

A log says what it holds in a schema. Writers and readers of any version agree on JSON: a field that an old entry lacks is null, one that
the schema doesn't name stays in the file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Log:
    """schema: DDL of all columns; at: the time by which entries are dealt into days and ordered; id: what orders entries of one time."""

    schema: str
    at: str
    id: str

    @property
    def fields(self) -> list[T.StructField]:
        return list(T._parse_datatype_string(self.schema).fields)


#: What is kept of questions, of record repairs, of fines and of reports.
QUERIES = Log("id long, ts timestamp_ntz, plate string, requested_attrs array<string>, sources_asked array<string>, statuses map<string,string>, decision string, confidence string, elapsed_ms double", "ts", "id")
CLEANSING = Log("log_id long, source_id string, record_id string, field string, action string, before_value string, after_value string, rule_id string, rule_path array<string>, evidence map<string,string>, actor string, applied_at timestamp_ntz, decision string, note string, undone_at timestamp_ntz, undone_by string", "applied_at", "log_id")
CASES = Log("event_id long, case_id long, at timestamp_ntz, event string, actor string, detail struct<verdict:string,reason:string,amount_inr:long>", "at", "event_id")
REPORTS = Log("id long, at timestamp_ntz, plate string, story array<struct<title:string,text:string>>", "at", "id")


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def append(log: Log, entries: DataFrame, path: str) -> None:
    """Entries of a log, added to its folder; columns that it doesn't have are refused, those that entries lack are null."""
    names = {f.name for f in log.fields}
    if unknown := {*entries.columns} - names:
        raise ValueError(f"the log has no columns {sorted(unknown)}")
    own = {f.name: (F.col(f.name) if f.name in entries.columns else F.lit(None)).cast(f.dataType) for f in log.fields}
    rows = entries.select(*((F.to_json(c) if _nested(f.dataType) else c).alias(f.name) for f, c in zip(log.fields, own.values())))
    rows.withColumn("day", F.to_date(log.at)).write.mode("append").partitionBy("day").parquet(path)


def read(log: Log, spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """All entries, typed; only the folders of the days from ``since`` to ``until`` are looked into."""
    stored = ", ".join(f"`{f.name}` {'string' if _nested(f.dataType) else f.dataType.simpleString()}" for f in log.fields)
    rows = spark.read.schema(f"{stored}, day date").parquet(path)
    if since is not None:
        rows = rows.filter(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.filter(F.col("day") <= F.lit(until).cast("date"))
    return rows.select(*(F.from_json(f.name, f.dataType).alias(f.name) if _nested(f.dataType) else F.col(f.name) for f in log.fields))


def newest(log: Log, entries: DataFrame, n: int, **equal) -> DataFrame:
    """The newest n entries whose columns have the given values, newest first: a top-k, not a sort of the log."""
    for c, v in equal.items():
        entries = entries.filter(F.col(c) == F.lit(v))
    return entries.orderBy(F.desc_nulls_last(log.at), F.desc(log.id)).limit(n)
