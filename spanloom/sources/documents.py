"""Documents of captures: histograms, stack samples, receipts and manifests as JSON; activations as Parquet or NDJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTOGRAM = (
    "session_id string, target_running boolean, last_sample_rate_hz double, in_scope_hits bigint, out_of_scope_hits bigint, observed_duration_ns bigint, retained_runtime_percent double, snoop_failures bigint, "
    "buckets array<struct<start:bigint,end:bigint,hits:bigint>>"
)
STACKS = "session_id string, attempted bigint, collected bigint, max_frames int, samples array<struct<index:bigint,termination:string,halt_ns:bigint,frames:array<string>>>"
RECEIPT = "session_id string, provider string, covered_cores array<bigint>, capabilities map<string,struct<support:string,reasons:array<string>>>"
MANIFEST = (
    "session_id string, tool struct<name:string,version:string>, capture struct<mode:string,adapter:struct<id:string,version:string>,request_sha256:string,target:struct<architecture:string,device:string,board:string,core_count:bigint>>, "
    "clocks array<struct<id:string,frequency_hz:bigint>>, artifacts array<struct<artifact_id:string,path:string,size:bigint,sha256:string,inputs:array<string>>>"
)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file; a file that is none ends the job."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def histograms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What each histogram says of itself, and its buckets: session_id, start, end, hits."""
    docs = _read(spark, path, HISTOGRAM)
    return docs.drop("buckets"), docs.select("session_id", F.explode("buckets").alias("b")).select("session_id", "b.*")


def stack_samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What each document says of itself, and its samples: session_id, sample_index, termination, halt_ns, frames."""
    docs = _read(spark, path, STACKS)
    rows = docs.select("session_id", F.explode("samples").alias("s")).select("session_id", F.col("s.index").alias("sample_index"), "s.termination", "s.halt_ns", "s.frames")
    return docs.drop("samples"), rows


def stack_accounting(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """Attempted, collected and included samples of each session, the time it was halted, and whether they agree."""
    own = samples.groupBy("session_id").agg(F.count("*").alias("included"), F.sum("halt_ns").alias("halt_ns"), F.count_if(F.col("termination") == "truncated").alias("truncated"))
    both = documents.join(own, "session_id", "left").fillna(0, ["included", "halt_ns", "truncated"])
    return both.select("session_id", "attempted", "collected", "included", "halt_ns", "truncated", ((F.col("included") == F.col("collected")) & (F.col("collected") <= F.col("attempted"))).alias("balanced"))


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each ability that a receipt declares: session_id, family, support, reasons."""
    docs = _read(spark, path, RECEIPT)
    return docs.select("session_id", F.explode("capabilities").alias("family", "c")).select("session_id", "family", "c.*")


def manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Facts of each capture as ``compare.sides`` reads them, and its artifacts."""
    docs = _read(spark, path, MANIFEST)
    facts = docs.select(
        "session_id", F.col("tool.name").alias("tool_name"), F.col("tool.version").alias("tool_version"), "capture.mode", F.col("capture.adapter.id").alias("adapter_id"), F.col("capture.adapter.version").alias("adapter_version"), "capture.request_sha256", "capture.target.*", "clocks",
    )
    return facts, docs.select("session_id", F.explode("artifacts").alias("a")).select("session_id", "a.*")


def write_spans(spans: DataFrame, path: str) -> None:
    """Activations by session, in stream order, as Parquet."""
    spans.repartition("session_id").sortWithinPartitions("session_id", "ord").write.partitionBy("session_id").parquet(path)


def write_spans_ndjson(spans: DataFrame, path: str, input_id: str) -> None:
    """Activations as lines of JSON; each file starts with what its lines were made from."""
    rows = spans.select("session_id", F.struct(F.lit(1).alias("step"), "ord").alias("at"), F.to_json(F.struct(*spans.columns)).alias("value"))
    heads = spans.select("session_id").distinct().select("session_id", F.struct(F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("ord")).alias("at"), F.to_json(F.struct("session_id", F.lit(input_id).alias("input"))).alias("value"))
    rows.unionByName(heads).repartition("session_id").sortWithinPartitions("session_id", "at").select("session_id", "value").write.partitionBy("session_id").text(path)


def read_spans_ndjson(spark: SparkSession, path: str, schema: str, input_id: str, most: int = 1 << 16) -> DataFrame:
    """The activations again; a line that is too long, malformed or of another input is marked in ``violation``."""
    lines = spark.read.text(path)
    head = F.from_json("value", "input string")
    parsed = lines.withColumns({"input": F.get_json_object("value", "$.input"), "span": F.from_json("value", schema), "long": F.octet_length("value") > most, "ok": F.from_json("value", "session_id string, ord bigint")})
    own = parsed.where("input IS NULL")
    wrong = parsed.where(F.col("input").isNotNull() & (head["input"] != input_id)).select("session_id").distinct().withColumn("other", F.lit(True))
    reason = F.when(F.col("long"), "line_too_long").when(F.col("other"), "other_input").when(F.col("ok.ord").isNull(), "malformed_line")
    return own.join(wrong, "session_id", "left").select("span.*", reason.alias("violation"))
