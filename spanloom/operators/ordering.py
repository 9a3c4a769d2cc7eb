"""From raw exports to one ordered stream: clocks, sequences, merging and dictionary checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.scalar import offset_ns


def unwrapped(rows: DataFrame, raw: str, modulus: str, out: str, by: tuple[str, ...] = ("session_id", "source_id")) -> DataFrame:
    """Add a counter that no longer wraps: the modulus times the number of falls so far."""
    order = Window.partitionBy(*by).orderBy("ord")
    fell = (F.col(raw) < F.lag(raw).over(order)).cast("bigint")
    rows = rows.withColumn("_fell", F.coalesce(fell, F.lit(0)))
    return rows.withColumn(out, F.col(raw) + F.col(modulus) * F.sum("_fell").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fell")


def step_violations(rows: DataFrame, value: str, most: str, by: tuple[str, ...] = ("session_id", "source_id")) -> DataFrame:
    """Rows that step further than the clock domain allows."""
    order = Window.partitionBy(*by).orderBy("ord")
    step = F.col(value) - F.lag(value).over(order)
    return rows.withColumn("step", step).where(F.col("step") > F.col(most)).select(*by, "ord", "step")


def session_time(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """ts_ns of each row from expanded ticks and its source's clock domain.

    ``domains``: session_id, source_id, numerator, denominator, origin_ticks (null: the first row's), origin_ns.
    """
    first = F.first("ticks").over(Window.partitionBy("session_id", "source_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = rows.withColumn("_first", first).join(domains, ["session_id", "source_id"])
    at = offset_ns(F.col("ticks"), F.coalesce(F.col("origin_ticks"), F.col("_first")), F.col("numerator"), F.col("denominator"))
    return placed.withColumn("ts_ns", at + F.col("origin_ns")).drop("_first", "numerator", "denominator", "origin_ticks", "origin_ns")


def lost(rows: DataFrame, raw: str = "sequence", bits: int = 32) -> DataFrame:
    """Records missing before each one by a wrapping sequence; more than half the range back is a regression."""
    order = Window.partitionBy("session_id", "source_id").orderBy("ord")
    ahead = F.pmod(F.col(raw) - F.lag(raw).over(order), F.lit(1 << bits))
    back = ahead >= (1 << (bits - 1))
    return rows.withColumn("regressed", F.coalesce((ahead == 0) | back, F.lit(False))).withColumn("missing", F.when((ahead > 0) & ~back, ahead - 1).otherwise(0))


def merged(sources: list[DataFrame]) -> DataFrame:
    """All sources as one stream by (ts_ns, order_key), with a new ``ord``."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    order = Window.partitionBy("session_id").orderBy("ts_ns", F.asc_nulls_last("order_key"), "source_id", "source_seq")
    return rows.withColumn("ord", F.row_number().over(order).cast("bigint"))


def tie_violations(rows: DataFrame) -> DataFrame:
    """Times at which several sources have rows whose order keys do not tell them apart."""
    groups = rows.groupBy("session_id", "ts_ns").agg(F.count_distinct("source_id").alias("sources"), F.count("*").alias("rows"), F.count_distinct("order_key").alias("keys"))
    return groups.where("sources > 1 AND keys < rows").select("session_id", "ts_ns", "sources", "rows")


def dictionary_conflicts(definitions: DataFrame) -> DataFrame:
    """Ids with several definitions; equal ones from several sources are one."""
    other = [c for c in definitions.columns if c not in ("session_id", "kind", "id")]
    distinct = definitions.select("session_id", "kind", "id", F.struct(*other).alias("d")).distinct()
    return distinct.groupBy("session_id", "kind", "id").agg(F.count("*").alias("definitions")).where("definitions > 1")


def observation_violations(rows: DataFrame) -> DataFrame:
    """The first broken rule of each row: identity, sample target, weights, durations, finite values."""
    kind = F.col("type")
    reason = (
        F.when(F.coalesce(F.col("source_id"), F.lit("")) == "", "empty_source")
        .when((kind == "Sample") & F.col("function_id").isNull() & F.col("address").isNull(), "sample_without_target")
        .when((kind == "Sample") & (F.col("weight_ns") == 0), "zero_weight")
        .when((kind == "TraceGap") & (F.coalesce("duration_ns", F.lit(0)) <= 0), "empty_gap")
        .when((kind == "Counter") & (F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))), "counter_not_finite")
        .when(kind.isin("FunctionEnter", "FunctionExit") & (F.coalesce(F.col("function_id"), F.lit("")) == ""), "empty_function")
    )
    return rows.withColumn("violation", reason).where("violation IS NOT NULL")
