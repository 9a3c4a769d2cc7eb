"""Resource counters: summaries, rates, fragmentation, and the rules their values must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.scalar import QUALITY, rank, unrank

_BYTES, _COUNT = "bytes", "count"
#: Semantic, unit, behaviour, class, kind of subject, whether whole numbers only.
SEMANTICS = [
    ("heap.current_allocated_bytes", _BYTES, "gauge", "heap", "allocator", True),
    ("heap.free_bytes", _BYTES, "gauge", "heap", "allocator", True),
    ("heap.largest_free_block_bytes", _BYTES, "gauge", "heap", "allocator", True),
    ("heap.peak_allocated_bytes", _BYTES, "high_watermark", "heap", "allocator", True),
    ("heap.largest_allocation_bytes", _BYTES, "high_watermark", "heap", "allocator", True),
    ("heap.allocation_count", _COUNT, "monotonic", "heap", "allocator", True),
    ("heap.free_count", _COUNT, "monotonic", "heap", "allocator", True),
    ("heap.allocation_rate_per_second", "1/s", "rate", "heap", "allocator", False),
    ("heap.external_fragmentation_ratio", "ratio", "ratio", "heap", "allocator", False),
    ("stack.capacity_bytes", _BYTES, "capacity", "stack", "stack", True),
    ("stack.current_used_bytes", _BYTES, "gauge", "stack", "stack", True),
    ("stack.peak_used_bytes", _BYTES, "high_watermark", "stack", "stack", True),
    ("ram.current_used_bytes", _BYTES, "gauge", "ram", "memory_region", True),
    ("ram.peak_used_bytes", _BYTES, "high_watermark", "ram", "memory_region", True),
    ("trace_buffer.capacity_bytes", _BYTES, "capacity", "trace_buffer", "trace_buffer", True),
    ("trace_buffer.current_used_bytes", _BYTES, "gauge", "trace_buffer", "trace_buffer", True),
    ("trace_buffer.peak_used_bytes", _BYTES, "high_watermark", "trace_buffer", "trace_buffer", True),
]


def semantics(spark) -> DataFrame:
    return spark.createDataFrame(SEMANTICS, "semantic string, unit string, behaviour string, class string, subject_kind string, whole boolean")


def checked(counters: DataFrame) -> DataFrame:
    """Add ``in_range`` and ``violation`` to (session_id, counter_id, ord, ts_ns, value, behaviour, whole).

    Values out of range never enter an aggregate. A falling monotonic counter or watermark and a changed
    capacity do, but end the counter's valid window.
    """
    value = F.col("value")
    whole = ~F.coalesce(F.col("whole"), F.lit(False)) | (value == F.floor(value)) & (value <= 2.0**53)
    ratio = (F.col("behaviour") != "ratio") | (value <= 1)
    in_range = ~F.isnan(value) & (F.abs(value) != float("inf")) & (F.col("behaviour").isNull() | (value >= 0) & whole & ratio)
    rows = counters.withColumn("in_range", F.coalesce(in_range, F.lit(False)))
    before = F.last(F.when(F.col("in_range"), value), ignorenulls=True).over(Window.partitionBy("session_id", "counter_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    broken = F.col("behaviour").isin("monotonic", "high_watermark") & (value < before) | (F.col("behaviour") == "capacity") & (value != before)
    return rows.withColumn("violation", F.when(~F.col("in_range"), "resource_counter_out_of_range").when(broken & (F.col("behaviour") == "capacity"), "resource_counter_invariant_violation").when(broken, "resource_counter_not_monotonic"))


def summary(rows: DataFrame) -> DataFrame:
    """One row for each counter of each session: first, latest, least, greatest, mean, delta and rate.

    ``rows`` come from ``checked``. The delta needs two values and an unbroken window; the rate needs a
    monotonic counter and a window of some length.
    """
    used = rows.where("in_range")
    valid = rows.groupBy("session_id", "counter_id").agg(F.bool_and(F.col("violation").isNull()).alias("window_valid"))
    found = used.groupBy("session_id", "counter_id").agg(
        F.count("*").alias("n"), F.min("ts_ns").alias("first_ts_ns"), F.max("ts_ns").alias("last_ts_ns"), F.min_by("value", "ord").alias("first"), F.max_by("value", "ord").alias("latest"), F.min("value").alias("least"),
        F.max("value").alias("greatest"), F.avg("value").alias("mean"), F.max(rank(F.col("quality"), QUALITY)).alias("q"), F.first("behaviour", ignorenulls=True).alias("behaviour"),
    )
    out = found.join(valid, ["session_id", "counter_id"])
    change = F.when((F.col("n") >= 2) & F.col("window_valid"), F.col("latest") - F.col("first"))
    span = F.col("last_ts_ns") - F.col("first_ts_ns")
    return out.withColumn("quality", unrank(F.col("q"), QUALITY)).withColumn("delta", change).withColumn("window_ns", F.when(F.col("n") >= 2, span)).withColumn("rate_per_s", F.when((F.col("behaviour") == "monotonic") & (span > 0), change * 1e9 / span)).drop("q")


def usage_violations(rows: DataFrame) -> DataFrame:
    """Places where the latest known current, peak and capacity of a subject break current <= peak <= capacity.

    ``rows`` has session_id, subject, role (current, peak or capacity), ord and value.
    """
    upto = Window.partitionBy("session_id", "subject").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    for role in ("current", "peak", "capacity"):
        rows = rows.withColumn(role, F.last(F.when(F.col("role") == role, F.col("value")), ignorenulls=True).over(upto))
    return rows.where("current > peak OR peak > capacity OR current > capacity").select("session_id", "subject", "ord", "current", "peak", "capacity")


def fragmentation(rows: DataFrame) -> DataFrame:
    """1 - largest free block / free bytes at the latest time both were read, by session and subject.

    ``rows`` has session_id, subject, role (free or largest), ord, ts_ns and value. The reason says why a
    ratio is missing.
    """
    upto = Window.partitionBy("session_id", "subject").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    for role in ("free", "largest"):
        rows = rows.withColumn(role, F.last(F.when(F.col("role") == role, F.struct("ts_ns", "value")), ignorenulls=True).over(upto))
    found = rows.groupBy("session_id", "subject").agg(F.max_by(F.struct("free", "largest", "ord"), F.when(F.col("free.ts_ns") == F.col("largest.ts_ns"), F.col("ord"))).alias("at"), F.bool_or(F.col("free").isNotNull()).alias("has_free"), F.bool_or(F.col("largest").isNotNull()).alias("has_largest"))
    free, largest = F.col("at.free.value"), F.col("at.largest.value")
    reason = F.when(~F.col("has_free") | ~F.col("has_largest"), "input_missing").when(F.col("at").isNull(), "inputs_not_synchronized").when(free == 0, "no_free_memory").when(largest > free, "largest_exceeds_free")
    return found.select("session_id", "subject", F.col("at.free.ts_ns").alias("ts_ns"), F.when(reason.isNull(), 1 - largest / free).alias("ratio"), reason.alias("reason"))


def allocation_rate(summaries: DataFrame) -> DataFrame:
    """Allocations a second of each subject whose rate was not measured itself, or the reason why there is none.

    ``summaries`` are those of ``summary`` with semantic and subject.
    """
    counts = summaries.where("semantic = 'heap.allocation_count'")
    measured = summaries.where("semantic = 'heap.allocation_rate_per_second'").select("session_id", "subject")
    reason = F.when(F.col("n") < 2, "fewer_than_two_values").when(~F.col("window_valid"), "window_not_valid").when(F.col("window_ns") <= 0, "empty_window")
    rate = F.when(reason.isNull(), F.col("delta") * 1e9 / F.col("window_ns"))
    return counts.join(measured, ["session_id", "subject"], "left_anti").select("session_id", "subject", rate.alias("per_second"), reason.alias("reason"))
