"""Tables of SQL databases as a data source: read by executors, in ranges of a key, with filters pushed to the database.

Any library that keeps to Python's DB-API will do; it is named by its module and must be there on the executors. Statements are
written by a Builder, which another dialect replaces.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from concordia.functions.similarity import CONFUSABLE

#: Rows that are fetched, and handed on as one Arrow batch, at a time.
ROWS = 10_000


def literal(value) -> str:
    """A value as SQL: quotes doubled, truth as 1 or 0."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


class Builder:
    """SQL of common dialects: names quoted, and the predicates by which keys are found however a source spells them."""

    def name(self, column: str) -> str:
        return ".".join('"' + part.replace('"', '""') + '"' for part in column.split("."))

    def plain(self, column: str) -> str:
        return f"UPPER(REPLACE(REPLACE({self.name(column)}, '-', ''), ' ', ''))"

    def key(self, column: str, plate: str) -> str:
        """Equality of normalised spellings."""
        return f"{self.plain(column)} = {literal(plate.upper())}"

    def folded(self, column: str, plate: str) -> str:
        """Equality up to O for 0 and I for 1."""
        fold = lambda sql: f"REPLACE(REPLACE({sql}, 'O', '0'), 'I', '1')"
        return f"{fold(self.plain(column))} = {literal(plate.upper().replace('O', '0').replace('I', '1'))}"

    def rendered(self, column: str, spelling: str) -> str:
        """The key as the source itself spells it: an index on the column serves."""
        return f"{self.name(column)} = {literal(spelling)}"

    def one_of(self, column: str, plate: str) -> str:
        """The key or one of its versions with one confusable sign replaced."""
        p = plate.upper()
        versions = [p, *(p[:i] + o + p[i + 1 :] for i, c in enumerate(p) for o in CONFUSABLE.get(c, ""))]
        return f"{self.plain(column)} IN ({', '.join(map(literal, versions))})"

    def near(self, column: str, plate: str) -> str:
        """The same first two signs and nearly the same length."""
        if len(plate) < 2:
            return "1=1"
        return f"({self.plain(column)} LIKE {literal(plate[:2].upper() + '%')} AND LENGTH({self.plain(column)}) BETWEEN {max(1, len(plate) - 1)} AND {len(plate) + 1})"

    def filter(self, f: D.Filter) -> str | None:
        """A filter of Spark's as SQL, or None if it has to be left to Spark. Comparisons must mean the same in both."""
        if isinstance(f, D.Not):
            inner = self.filter(f.child) if isinstance(f.child, (D.EqualTo, D.In, D.IsNull, D.IsNotNull)) else None
            return inner and f"NOT ({inner})"
        if len(f.attribute) != 1:
            return None
        c = self.name(f.attribute[0])
        if isinstance(f, (D.IsNull, D.IsNotNull)):
            return f"{c} IS {'NOT ' * isinstance(f, D.IsNotNull)}NULL"
        simple = lambda v: isinstance(v, (int, float, str)) and v == v
        if isinstance(f, D.In):
            return f"{c} IN ({', '.join(map(literal, f.value))})" if f.value and all(map(simple, f.value)) else None
        if isinstance(f, D.StringStartsWith):
            return f"SUBSTR({c}, 1, {len(f.value)}) = {literal(f.value)}"
        signs = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
        return f"{c} {signs[type(f)]} {literal(f.value)}" if type(f) in signs and simple(f.value) else None

    def select(self, columns: list[str], table: str, where: list[str]) -> str:
        return f"SELECT {', '.join(map(self.name, columns))} FROM {self.name(table)}" + (f" WHERE {' AND '.join(where)}" if where else "")


def _builder(options) -> Builder:
    module, _, name = options.get("builder", f"{__name__}:Builder").partition(":")
    return getattr(importlib.import_module(module), name)()


def _connect(options):
    return importlib.import_module(options.get("module", "sqlite3")).connect(**json.loads(options["connect"]))


class Range(D.InputPartition):
    """Keys from low to high, high not included in all but the last; None: rows whose key is null."""

    def __init__(self, low, high, last: bool):
        super().__init__(None)
        self.low, self.high, self.last = low, high, last


class Reader(D.DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.options, self.where = schema, dict(options), [options["where"]] if options.get("where") else []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        builder = _builder(self.options)
        for f in filters:
            sql = builder.filter(f)
            if sql is None:
                yield f
            else:
                self.where.append(sql)

    def partitions(self):
        """Ranges of equal width between the smallest and largest key; that is all that the driver asks for."""
        key, parts = self.options.get("key"), int(self.options.get("parts", 1))
        if not key or parts < 2:
            return [Range(None, None, True)]
        c = _builder(self.options).name(key)
        connection = _connect(self.options)
        try:
            cursor = connection.cursor()
            cursor.execute(f"SELECT MIN({c}), MAX({c}) FROM {_builder(self.options).name(self.options['table'])}")
            low, high = cursor.fetchone()
        finally:
            connection.close()
        if low is None:
            return [Range(None, None, True)]
        edges = sorted({int(low) + (int(high) + 1 - int(low)) * i // parts for i in range(parts)} | {int(high) + 1})
        return [Range(a, b, False) for a, b in zip(edges, edges[1:])] + [Range(None, None, False)]

    def read(self, part: Range):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        builder, where = _builder(self.options), list(self.where)
        if not part.last:
            c = builder.name(self.options["key"])
            where.append(f"{c} IS NULL" if part.low is None else f"{c} >= {literal(part.low)} AND {c} < {literal(part.high)}")
        arrow = to_arrow_schema(self.schema)
        connection = _connect(self.options)
        try:
            cursor = connection.cursor()
            cursor.execute(builder.select([f.name for f in self.schema], self.options["table"], where))
            while rows := cursor.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        finally:
            connection.close()


class Database(D.DataSource):
    """Options: module (a DB-API library), connect (its arguments as JSON), table, key and parts (for ranges), where, builder (module:class)."""

    @classmethod
    def name(cls) -> str:
        return "concordia_database"

    def schema(self):
        raise ValueError("the columns to read must be given as a schema")

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)


def read(spark: SparkSession, schema: str | StructType, table: str, connect: dict, module: str = "sqlite3", key: str | None = None, parts: int = 1, where: str | None = None, builder: str | None = None) -> DataFrame:
    """A table of a database; only the columns of ``schema`` are asked for, however many rows there are.

    ``key``, a column of whole numbers, parts the reading into ranges, and a part for nulls. Filters on columns are run by the
    database where the builder can write them; ``where`` is a predicate of a Builder's, for keys.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Database)
    options = {"module": module, "connect": json.dumps(connect), "table": table, "key": key, "parts": parts, "where": where, "builder": builder}
    return spark.read.format("concordia_database").options(**{k: v for k, v in options.items() if v is not None}).schema(schema).load()
