"""Scans: mapped CSV, sampling text, linker maps and stack-usage files; the members of canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.scalar import address, section_ok, time_token_ns

#: Columns of an observation in its canonical record.
OBSERVATION = (
    "source_id string, source_seq bigint, quality string, type string, ts_ns bigint, core_id bigint, context_id string, function_id string, frame_id string, prev_context_id string, next_context_id string, "
    "reason string, interrupt_id string, priority int, activation_id string, address decimal(20,0), weight_ns bigint, name string, args string, span_id string, correlation_id string, counter_id string, value double, duration_ns bigint, key string"
)
#: Members that each event type may have besides the common ones.
MEMBERS = {
    "FunctionEnter": ["core_id", "context_id", "function_id", "frame_id"],
    "FunctionExit": ["core_id", "context_id", "function_id", "frame_id"],
    "ContextSwitch": ["core_id", "prev_context_id", "next_context_id", "reason"],
    "InterruptEnter": ["core_id", "interrupt_id", "priority", "activation_id"],
    "InterruptExit": ["core_id", "interrupt_id", "priority", "activation_id"],
    "Sample": ["core_id", "context_id", "function_id", "address", "weight_ns"],
    "Instant": ["core_id", "context_id", "name", "args"],
    "SpanBegin": ["core_id", "context_id", "span_id", "name", "args"],
    "SpanEnd": ["core_id", "context_id", "span_id", "args"],
    "AsyncBegin": ["core_id", "context_id", "correlation_id", "name", "args"],
    "AsyncEnd": ["core_id", "context_id", "correlation_id", "args"],
    "Counter": ["core_id", "context_id", "counter_id", "value", "args"],
    "TraceGap": ["duration_ns", "reason"],
    "Metadata": ["key", "value"],
}

def resolve_columns(header: list[str], mapping: dict[str, str], ignored: list[str]) -> None:
    """Every column is mapped or ignored, none twice, and time, sequence and type are there."""
    problems = [f"{c} appears twice" for c in {c for c in header if header.count(c) > 1}]
    problems += [f"{k} is required" for k in ("timestamp_ticks", "source_sequence", "event_type") if k not in mapping]
    problems += [f"{c} is missing" for c in [*mapping.values(), *ignored] if c not in header]
    problems += [f"{c} is neither mapped nor ignored" for c in header if c not in mapping.values() and c not in ignored]
    problems += [f"{c} is mapped twice" for c in {c for c in mapping.values() if list(mapping.values()).count(c) > 1}]
    if problems:
        raise ValueError("; ".join(sorted(problems)))


#: Event types of mapped CSV.
CSV_TYPES = {
    "function_enter": "FunctionEnter", "function_exit": "FunctionExit", "context_switch": "ContextSwitch", "interrupt_enter": "InterruptEnter", "interrupt_exit": "InterruptExit", "sample": "Sample", "instant": "Instant",
    "span_begin": "SpanBegin", "span_end": "SpanEnd", "async_begin": "AsyncBegin", "async_end": "AsyncEnd", "counter": "Counter", "trace_gap": "TraceGap", "metadata": "Metadata",
}


def read_mapped_csv(spark: SparkSession, path: str, mapping: dict[str, str], source_id: str, ignored: list[str] | None = None) -> DataFrame:
    """CSV with an explicit column mapping, read as text and cast where the mapping says numbers."""
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST")
    resolve_columns(raw.columns, mapping, ignored or [])

    def of(name: str, kind: str = "string") -> Column:
        return F.col(f"`{mapping[name]}`").try_cast(kind) if name in mapping else F.lit(None).cast(kind)

    types = F.create_map(*[F.lit(x) for pair in CSV_TYPES.items() for x in pair])
    numbers = {"core_id": "bigint", "priority": "int", "weight_ns": "bigint", "duration_ns": "bigint", "value": "double"}
    names = ("core_id", "context_id", "function_id", "frame_id", "interrupt_id", "priority", "activation_id", "weight_ns", "name", "span_id", "correlation_id", "counter_id", "value", "duration_ns", "reason")
    return raw.select(
        F.lit(source_id).alias("source_id"), of("source_sequence", "bigint").alias("source_seq"), of("timestamp_ticks", "decimal(20,0)").alias("ticks"), F.try_element_at(types, of("event_type")).alias("type"), of("order_key", "bigint").alias("order_key"),
        of("previous_context_id").alias("prev_context_id"), of("next_context_id").alias("next_context_id"), address(of("address")).alias("address"), of("metadata_key").alias("key"), of("metadata_value").alias("metadata"), *[of(n, numbers.get(n, "string")).alias(n) for n in names],
    )


def read_sampling_text(spark: SparkSession, path: str) -> DataFrame:
    """Sampling export: record, class:address, cycle, time and an optional symbol, white space between.

    A line that is neither blank nor a record is kept with ``bad``, and nothing else.
    """
    text = spark.read.text(path)
    pattern = r"^\s*([+-]?\d+)\s+(\S+)\s+(\S+)\s+([0-9.]+\s*(?:ps|ns|us|ms|s))\s*(.*?)\s*$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    good = F.col("value").rlike(pattern)
    rows = text.where(F.trim("value") != "").select(F.when(good, part(1).try_cast("bigint")).alias("record"), address(part(2)).alias("address"), part(3).alias("cycle"), time_token_ns(part(4)).alias("ts_ns"), F.nullif(part(5), F.lit("")).alias("symbol"), F.when(~good, "malformed_line").alias("bad"))
    return rows.withColumn("quality", F.lit("statistical")).withColumn("type", F.lit("Sample")).withColumnRenamed("record", "ord")


def read_linker_map(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """Top-level output sections with a configured name: name, address, size_bytes, kind."""
    pattern = r"^(\S+)\s+(0[xX][0-9A-Fa-f]+|\d+)\s+(0[xX][0-9A-Fa-f]+|\d+)(?:\s|$)"
    part = lambda i: F.regexp_extract("value", pattern, i)
    rows = spark.read.text(path).where(F.col("value").rlike(pattern)).select(part(1).alias("name"), address(part(2)).alias("address"), address(part(3)).cast("bigint").alias("size_bytes"))
    return rows.withColumn("kind", F.try_element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("name"))).where("kind IS NOT NULL")


def read_stack_usage(spark: SparkSession, path: str) -> DataFrame:
    """Compiler stack usage: file, line, column, function, bytes, qualifier; ``ambiguous`` locations are flagged."""
    parts = F.split("value", "\t")
    place = parts[0]
    pattern = r"^(.*?):(\d+):(\d+):(.*)$"
    return spark.read.text(path).where(F.size(parts) == 3).select(
        F.regexp_extract(place, pattern, 1).alias("file"), F.regexp_extract(place, pattern, 2).try_cast("bigint").alias("line"), F.regexp_extract(place, pattern, 3).try_cast("bigint").alias("column"), F.regexp_extract(place, pattern, 4).alias("function"),
        parts[1].try_cast("bigint").alias("bytes"), parts[2].alias("qualifier"), (F.size(F.regexp_extract_all(place, F.lit(r"(?=:(\d+):(\d+):)"), F.lit(0))) != 1).alias("ambiguous"),
    )


def static_totals(sections: DataFrame) -> DataFrame:
    """Bytes of each kind and in all, one row a session."""
    kinds = ("data", "bss", "noinit", "dma", "rtos", "custom")
    return sections.groupBy("session_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("size_bytes"))), F.lit(0)).alias(f"{k}_bytes") for k in kinds], F.sum("size_bytes").alias("total_bytes"))


def section_violations(sections: DataFrame) -> DataFrame:
    """Sections that appear twice in a session, or whose name is none."""
    many = F.count("*").over(Window.partitionBy("session_id", "name"))
    return sections.withColumn("many", many).select("session_id", "name", F.when(~section_ok(F.col("name")), "bad_name").when(F.col("many") > 1, "duplicate_section").alias("violation")).where("violation IS NOT NULL")


def stack_totals(entries: DataFrame) -> DataFrame:
    """Number of functions and the largest static frame."""
    return entries.groupBy("session_id").agg(F.count("*").alias("functions"), F.max(F.when(F.col("qualifier") == "static", F.col("bytes"))).alias("largest_static_bytes"))
