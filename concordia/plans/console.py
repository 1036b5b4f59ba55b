"""Ad-hoc SQL, read only: one query over named views."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Functions that run code outside the query, read the session or wait: a query may not call them.
FORBIDDEN = frozenset("reflect java_method try_reflect raise_error assert_true current_user session_user user current_database current_schema current_catalog version input_file_name input_file_block_start input_file_block_length spark_partition_id monotonically_increasing_id uuid sleep python_worker_logs".split())


class Refused(ValueError):
    """A statement that the console doesn't run."""


def named(spark: SparkSession, sql: str) -> set[str]:
    """The relations that a statement reads, sub-queries included, but those that it names itself (WITH)."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).treeString()
    if banned := {f.lower() for names in re.findall(r"'([\w.]+)\(", plan) for f in [names.split(".")[-1]]} & FORBIDDEN:
        raise Refused(f"function {sorted(banned)[0]}")
    own = {n.strip() for names in re.findall(r"(?:Unresolved)?With.*?CTE \[([^\]]*)\]|CTE \[([^\]]*)\]", plan) for part in names for n in part.split(",")}
    if functions := re.findall(r"UnresolvedTableValuedFunction \[([^\]]*)\]", plan):
        raise Refused(f"table function {functions[0]}")
    return {n.strip() for n in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan)} - own


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """The result of one SELECT over the given tables. Spark parses it, so words inside literals don't matter.

    Anything but a query is refused before it runs: Spark wraps the text as a sub-query, which only a query can be. So is
    a query that reads anything but the given tables: files, the catalogue's tables and views, table functions; and one that calls
    a function of FORBIDDEN, such as those that run any Java method. Two calls, or the caller's own views, don't meet.
    """
    text = sql.strip().rstrip(";").strip()
    if not re.match(r"(?is)^(select|with|values|table|from)\b|^\(", text):
        raise Refused("only one SELECT is allowed")
    wrapped = f"SELECT * FROM (\n{text}\n) AS console_query"
    try:
        others = {n for n in named(spark, wrapped) if n.lower() not in {t.lower() for t in tables}}
    except Refused:
        raise
    except Exception as e:
        raise Refused(str(e).splitlines()[0]) from None
    if others:
        raise Refused(f"unknown table {sorted(others)[0]}")
    # under names of this call's own, which the query's names stand for: the caller's views aren't touched, nor those of another call
    own = {n: f"_console_{uuid.uuid4().hex}" for n in tables}
    for n, df in tables.items():
        df.createOrReplaceTempView(own[n])
    names = ", ".join(f"`{n}` AS (SELECT * FROM `{v}`)" for n, v in own.items())
    try:
        out = spark.sql(f"WITH {names} {wrapped}" if names else wrapped)
    except Exception as e:
        raise Refused(str(e).splitlines()[0]) from None
    finally:
        for v in own.values():
            spark.catalog.dropTempView(v)
    return out if limit is None else out.limit(limit)
