"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's rows
to the shared folder and hands them to the next. All stages but the last return the columns of
``documents``; further columns of ``docs``, whatever their names, are not read. Rows without doc_id, and
rows that share one and differ in text, are documents of their own in every stage. An empty table
goes through all stages and gives no rows.

A stage's scratch tables belong to the pipeline: they go when its next stage begins, and those of
other queries stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import decontamination, language_id, line_dedup, packing, simhash
from latticework.llm.common import owned, read, release, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OWNER = "pipeline"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language go: null text, the empty text, text without a letter.

    ``lang`` is the predicted one where it was null. All rows that repeat a document stay here.
    """
    with owned(spark, OWNER):
        found = language_id.predict(docs, language_id.train(docs), keep=COLUMNS)
        return found.where(F.col("lang_pred") != language_id.UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document without a line left goes.

    Rows equal in doc_id and text are one document, and each keeps the same lines. Null text stays.
    """
    with owned(spark, OWNER):
        out = line_dedup.dedup_lines(docs, keep=["lang", "source", "n_chars"]).where(F.col("n_removed") < F.greatest(F.col("n_lines"), F.lit(1)))
        chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        return out.withColumn("n_chars", chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: that of the smallest doc_id, ids before none.

    Ties go to the smaller hash of the text; of rows equal in doc_id and text one stays. Null and
    empty texts are copies of each other.
    """
    with owned(spark, OWNER):
        return simhash.first_of_each(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; which, is told by doc_id and text, so rows that share an id are told apart.

    Null and empty texts stay.
    """
    with owned(spark, OWNER):
        found = decontamination.contaminated(docs, read(spark, sf_dir, "benchmark"), text_hash="found_th").select(F.col("doc_id").alias("found_id"), "found_th").distinct()
        docs = docs.select(*COLUMNS)
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("found_id")) & (F.xxhash64("text").eqNullSafe(F.col("found_th")))
        return docs.join(found, same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; null text is the empty text, rows that repeat a document are packed each."""
    with owned(spark, OWNER):
        return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("packing", pack)]

#: Models, tokenizers and 64-bit hashes have no counterpart in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = read(spark, sf_dir, "documents"), f"run-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            break
        with owned(spark, f"{tables}-{k}"):
            path = scratch_path(spark, f"stage-{k}-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, f"{tables}-{k - 1}")
    # the last stage's rows come from its own scratch tables, which hold all it read
    release(spark, f"{tables}-{len(STAGES) - 2}")
    return out
