"""The corpus pipeline: classify, drop near copies, remove repeated passages, mix sources, pack.

Each stage is a function of (spark, docs, sf_dir) over all that the one before it kept. All but the last return the
columns of ``documents``; run() writes each result as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm import curriculum, importance, packing, passages, simhash
from concordia.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance classifier accepts; it's fitted on ``labels`` and all of docs. Null and blank texts score 0."""
    weights, cut = importance.fit(docs, table(spark, sf_dir, "labels"))
    scored = importance.score(docs, weights, list(COLUMNS))
    return scored.filter(F.col("mean") >= F.lit(cut)).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of copies and near copies (five-word shingles, similarity 0.8)."""
    return simhash.without_copies(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word passages that one of a smaller id has; n_chars is of what is left."""
    found = passages.repeated_words(docs, carry=COLUMNS)
    text = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(F.col("kept_text"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select("row.doc_id", text.alias("text"), "row.lang", "row.source", n_chars.alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in training order; a copy taken in part ends after its last word that is taken."""
    copies = curriculum.sequence(curriculum.mix(docs, carry=COLUMNS))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.col("words") < curriculum.n_words(F.col("row.text"))
    text = F.when(part, F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")).otherwise(F.col("row.text"))
    n_chars = F.when(part, F.char_length(text).cast("long")).otherwise(F.col("row.n_chars"))
    return copies.select("row.doc_id", text.alias("text"), "row.lang", "row.source", n_chars.alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and the sequence and offset of each."""
    placed = packing.pack(packing.pieces(docs))
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [(f.__name__, f) for f in (quality_classifier, simhash_near_dedup, substring_dedup, source_mixing, best_fit_packing)]

#: Trained models, graph components and tokens aren't expressible in SQL; tests/llm holds each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
