"""An inverted index that outlives the call that built it: tokens of keys in buckets, brought up to date by what changed.

Keys are looked up by joins on tokens. The index's side of such a join is read as it lies, bucket by bucket; only the reads are shuffled.
A key's tokens stand in an order that never changes once it is given, rare ones first as they were when a token was first seen: prefix
and position filters need one order for all, not that of today. So a new key costs its own tokens, and a key that is gone a mark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.functions.similarity import qgrams
from concordia.functions.transforms import norm_plate

Tokenizer = Callable[[Column], Column]


def two_grams(key: Column) -> Column:
    return F.array_distinct(qgrams(key, 2))


class KeptIndex:
    """Tables under ``path``, which another session opens again by the same arguments. tokenizer: a key's different tokens; per_edit: how many an edit changes at most."""

    def __init__(self, spark: SparkSession, path: str, name: str, tokenizer: Tokenizer = two_grams, per_edit: int = 2, buckets: int = 16):
        self.spark, self.path, self.name, self.tokenizer, self.per_edit, self.buckets = spark, path.rstrip("/"), name, tokenizer, per_edit, buckets
        self._open("entries", "token string, key string, pos int, n int", "token")
        self._open("ranks", "token string, df long", "token")
        self._open("keys", "key string, version long, there boolean", "key")

    def _open(self, part: str, schema: str, by: str) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{part} ({schema}) USING parquet CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{part}'")

    def _table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def _append(self, part: str, rows: DataFrame, by: str) -> None:
        t = self._table(part)
        rows.select(*t.columns).repartition(self.buckets, by).write.mode("append").format("parquet").bucketBy(self.buckets, by).saveAsTable(f"{self.name}_{part}")

    def keys(self) -> DataFrame:
        """(key) of all keys that are there now: of each key's marks the last counts."""
        return self._table("keys").groupBy("key").agg(F.max_by("there", "version").alias("there")).filter("there").select("key")

    def refresh(self, registry: DataFrame, key: str) -> tuple[int, int]:
        """Brings the index to what the registry holds now; (keys added, keys gone). Nulls and blanks are no keys. Keys that come back aren't indexed anew."""
        from .repair import kept

        now = registry.select(norm_plate(F.col(key)).alias("key")).filter("key <> ''").distinct()
        held, ever = self.keys(), self._table("keys").select("key").distinct()
        version = (self._table("keys").agg(F.max("version")).first()[0] or 0) + 1
        new = kept(now.join(held, "key", "left_anti").join(ever.withColumn("seen", F.lit(True)), "key", "left"))
        gone = kept(held.join(now, "key", "left_anti"))
        added, lost = new.count(), gone.count()
        if added:
            t = kept(new.filter("seen is null").select("key", F.explode(self.tokenizer(F.col("key"))).alias("token")))
            fresh = kept(t.groupBy("token").agg(F.count("*").alias("df")).join(self._table("ranks").select("token"), "token", "left_anti"))
            self._append("ranks", fresh, "token")
            self._append("entries", self._placed(t, "key"), "token")
        marks = new.select("key", F.lit(True).alias("there")).unionByName(gone.select("key", F.lit(False).alias("there"))).withColumn("version", F.lit(version).cast("long"))
        if added or lost:
            self._append("keys", marks, "key")
        return added, lost

    def _placed(self, t: DataFrame, by: str) -> DataFrame:
        """Tokens with their place in the order; those that the index has never seen come first."""
        own = t.join(self._table("ranks"), "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        w = Window.partitionBy(by)
        return own.withColumns({"pos": F.row_number().over(w.orderBy("df", "token")), "n": F.count("*").over(w).cast("int")})

    def candidates(self, reads: DataFrame, read: str, edits: int = 2) -> DataFrame:
        """(read, key, shared): every key within ``edits`` edits of a read, and others near it; only tokens among the first of either side are joined."""
        x = reads.select(norm_plate(F.col(read)).alias("read")).filter("read <> ''").distinct().select("read", F.explode(self.tokenizer(F.col("read"))).alias("token"))
        slack = self.per_edit * edits
        x = self._placed(x, "read").select("read", "token", F.col("pos").alias("xp"), F.col("n").alias("nx"))
        front = self._table("entries").select("token", "key", F.col("pos").alias("yp"), F.col("n").alias("ny"))
        pairs = x.filter(F.col("xp") <= slack + 1).join(front.filter(F.col("yp") <= 2 * slack + 1), "token").filter(F.abs(F.col("nx") - F.col("ny")) <= slack)
        shared = F.size(F.array_intersect(self.tokenizer(F.col("read")), self.tokenizer(F.col("key")))).cast("long")
        found = pairs.select("read", "key", "nx", "ny").distinct().withColumn("shared", shared).filter(F.col("shared") >= F.greatest(F.lit(1), F.greatest("nx", "ny") - slack))
        return found.join(self.keys(), "key", "left_semi").select("read", "key", "shared")
