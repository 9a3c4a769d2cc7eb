"""Shared helpers: the shared scratch folder, lineage cuts, sizing and table reads."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a session in one process gets a new temporary folder; a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        known = context.getCheckpointDir()
        if not known:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
            known = context.getCheckpointDir()
        base = known
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back.

    Later stages read the files, so a lost executor costs a re-read and no recomputation.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def told_apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a column that numbers them apart, and its name.

    Where every doc_id is there once, the number is doc_id. Else rows are numbered once in a written table,
    so that every later read sees the same numbers.
    """
    [row] = fresh(docs, "row")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        return docs.withColumn(row, F.col("doc_id")), row
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes in a text column, by a two-level sum that ships one number a task."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts_for(total: int, each: int) -> int:
    """How many parts of about ``each`` hold ``total``; parts never grow with it."""
    return max(1, math.ceil(total / each))
