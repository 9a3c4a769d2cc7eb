"""Tables between jobs: lineage is cut by a table in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a session in one process takes a temporary folder; a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of a batch that goes to Python, and the value for which Spark does not look at them.
BATCH_BYTES, UNSIZED = "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)


@contextmanager
def unsized_batches(spark: SparkSession) -> Iterator[None]:
    """Batches that go to Python are cut by rows alone meanwhile, in this session.

    To hold a limit of bytes Spark sizes the batch anew after each row, column by column, which takes longer than
    writing a row of many short columns. Not for rows that may hold long texts.
    """
    before = spark.conf.get(BATCH_BYTES, None)  # nothing where it has not been set
    spark.conf.set(BATCH_BYTES, UNSIZED)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def kept(df: DataFrame, name: str, path: str | None = None, unsized: bool = False) -> DataFrame:
    """Write ``df`` and read it back; a lost executor costs a re-read and no recomputation.

    ``unsized``: what goes to Python in the course of it are narrow rows, in batches of a number of rows.
    """
    path = path or shared_path(df.sparkSession, name)
    with unsized_batches(df.sparkSession) if unsized else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
