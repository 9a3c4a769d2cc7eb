"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes all documents that the one before kept. ``run`` writes each stage's documents to the
shared folder as Parquet and reads them back for the next.

Rows are judged apart, also where doc_ids repeat or are null. Null and empty texts have no language and go with
the first stage, unless no document has a lang; where they come to a later stage, they stay, and packing gives
each its end id. An empty table gives no rows. Other columns than those of documents are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import DOCUMENTS, documents, told_apart, written
from spanloom.llm.decontaminate import decontaminate
from spanloom.llm.language import document_records, fit, identify
from spanloom.llm.line_dedup import line_dedup
from spanloom.llm.minhash_dedup import minhash_dedup
from spanloom.llm.packing import pack

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without letters or a clear language go. All stay where none has a lang."""
    model = fit(docs)
    if not model[0]:
        return docs.select(*DOCUMENTS)
    numbered, row = told_apart(docs)
    records = document_records(numbered.select(F.col(row).alias("doc_id"), "text", "source"))
    rejected = identify(records, model).where("NOT language_kept").select(F.col("doc_id").alias(row))
    return numbered.join(rejected, row, "left_anti").select(*DOCUMENTS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later three-line repeats; those left without a word go."""
    cleaned = line_dedup(docs).withColumn("n_chars", F.when(F.col("line_dedup_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return cleaned.where("line_dedup_removed = 0 OR trim(translate(text, '\t\r\n', '   ')) != ''").select(*DOCUMENTS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles at 0.8: the least doc_id.

    Where doc_ids repeat or are missing, the rows are the documents, and the one that comes first stays.
    """
    numbered, row = told_apart(docs)
    gone = minhash_dedup(numbered.select(F.col(row).alias("doc_id"), "text")).where("NOT kept").select(F.col("doc_id").alias(row))
    return numbered.join(gone, row, "left_anti").select(*DOCUMENTS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item aligns."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*DOCUMENTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in full sequences."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("minhash_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("pack", packing_stage),
]

#: Alignment and hashing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*DOCUMENTS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
