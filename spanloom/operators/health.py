"""Trust in a capture: facts, issues, verdicts, the support of each metric, and the gate on quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.scalar import SEVERITY, SUPPORT, VERDICT, fact_code, rank, unrank, worst
from spanloom.functions.tables import kept as written

#: Health codes by severity and by what they make unavailable.
RULES = {
    ("fatal", "all"): ["trace_overflow", "flow_error", "sampling_buffer_full", "sampling_unexpected_stop", "truncated_input", "malformed_input", "out_of_order_timestamp", "out_of_order_sequence", "timestamp_discontinuity", "program_flow_unclosed", "diagnostics_truncated", "invalid_health_observation", "invalid_health_policy_identity"],
    ("fatal", "function"): ["elf_mismatch"],
    ("error", "function"): ["unmatched_function_exit", "mismatched_function_exit", "unclosed_function"],
    ("error", "interrupt"): ["unmatched_interrupt_exit", "mismatched_interrupt_exit", "unclosed_interrupt", "duplicate_interrupt_activation"],
    ("error", "none"): ["duplicate_span_begin", "unmatched_span_end", "unclosed_span", "duplicate_async_begin", "unmatched_async_end", "unclosed_async", "open_custom_span_limit_exceeded"],
    ("error", "context"): ["context_mismatch", "context_switch_mismatch", "concurrent_context"],
    ("error", "all"): ["timestamp_overflow", "duration_overflow"],
    ("warning", "gap"): ["trace_gap"],
    ("warning", "context_inferred"): ["missing_scheduled_context"],
    ("warning", "resource"): ["invalid_resource_counter", "resource_counter_out_of_range", "resource_counter_not_monotonic", "resource_counter_invariant_violation", "resource_counter_window_incomplete"],
    ("error", "resource"): ["invalid_resource_counter_definition", "resource_counter_unit_mismatch", "resource_counter_subject_conflict"],
}
#: Verdict of each severity.
VERDICT_OF = {"info": "VALID", "warning": "DEGRADED", "error": "INVALID", "fatal": "INVALID"}
METRICS = ("wall_time", "active_time", "self_time", "call_count", "context_time", "interrupt_time", "sampling", "resource")
#: What an impact does to each metric it names; other metrics stay.
IMPACTS = {
    "all": dict.fromkeys(METRICS, "unavailable"),
    "function": dict.fromkeys(("wall_time", "active_time", "self_time", "call_count"), "unavailable"),
    "interrupt": dict.fromkeys(("active_time", "self_time", "interrupt_time"), "unavailable"),
    "context": dict.fromkeys(("active_time", "self_time", "context_time"), "unavailable"),
    "context_inferred": dict.fromkeys(("active_time", "self_time", "context_time"), "inferred"),
    "gap": dict.fromkeys(METRICS[:6], "inferred"),
    "resource": {"resource": "unavailable"},
    "none": {},
}
#: Facts of a session that are kept.
MOST_FACTS = 4096


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, s, i) for (s, i), codes in RULES.items() for c in codes], "code string, severity string, impact string")


def sequence_facts(observations: DataFrame) -> DataFrame:
    """Rows whose source sequence skips (trace_gap) or does not advance (out_of_order_sequence).

    The comparison is with the highest number so far, not with the row before.
    """
    before = Window.partitionBy("session_id", "source_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = observations.withColumn("highest", F.max("source_seq").over(before))
    code = F.when(F.col("source_seq") <= F.col("highest"), "out_of_order_sequence").when(F.col("source_seq") > F.col("highest") + 1, "trace_gap")
    return rows.select("session_id", "ord", code.alias("code"), (F.col("source_seq") - F.col("highest") - 1).alias("missing")).where("code IS NOT NULL")


def order_facts(observations: DataFrame) -> DataFrame:
    """Rows that go back in time on their core."""
    before = Window.partitionBy("session_id", "core_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = observations.where("core_id IS NOT NULL").withColumn("highest", F.max("ts_ns").over(before))
    return rows.where("ts_ns < highest").select("session_id", "ord", F.lit("out_of_order_timestamp").alias("code"))


def pair_facts(observations: DataFrame, begin: str, end: str, keys: list[str], names: tuple[str, str, str]) -> DataFrame:
    """Begin and end rows that do not pair on their keys: a second begin, an end alone, a begin left open."""
    rows = observations.where(F.col("type").isin(begin, end))
    order = Window.partitionBy("session_id", *keys).orderBy("ord")
    rows = rows.withColumn("before", F.lag("type").over(order)).withColumn("after", F.lead("type").over(order))
    twice, alone, left = names
    code = F.when((F.col("type") == begin) & (F.col("before") == begin), twice).when((F.col("type") == end) & ~F.col("before").eqNullSafe(begin), alone).when((F.col("type") == begin) & F.col("after").isNull(), left)
    return rows.select("session_id", "ord", code.alias("code")).where("code IS NOT NULL")


def capped(facts: DataFrame, most: int = MOST_FACTS) -> DataFrame:
    """The first facts of each session; beyond the limit the last place says how many were dropped.

    Each task passes on no more than the first ``most`` facts of a session and a count of all, so that a session with
    millions of facts is not sorted in one place.
    """
    rows = written(facts.select("session_id", "ord", "code"), "facts", unsized=True)  # read twice
    order = Window.partitionBy("session_id").orderBy("ord", "code")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    many = rows.groupBy("session_id").agg(F.count("*").alias("many")).withColumnRenamed("session_id", "of")
    kept = first.join(many, F.col("session_id").eqNullSafe(F.col("of")))
    sentinel = (F.col("many") > most) & (F.col("place") == most)
    return kept.select("session_id", "ord", F.when(sentinel, "diagnostics_truncated").otherwise(F.col("code")).alias("code"), F.when(sentinel, F.col("many") - (most - 1)).alias("dropped"))


def issues(facts: DataFrame) -> DataFrame:
    """Facts with severity, verdict and impact, by the code that a name means; one without a rule is fatal and makes all unavailable."""
    found = facts.withColumn("code", fact_code(F.col("code"))).join(F.broadcast(rules(facts.sparkSession)), "code", "left")
    severity = F.coalesce("severity", F.lit("fatal"))
    verdict = F.get(F.lit([VERDICT_OF[s] for s in SEVERITY]), rank(severity, SEVERITY))
    return found.select("session_id", "ord", "code", severity.alias("severity"), verdict.alias("verdict"), F.coalesce("impact", F.lit("all")).alias("impact"))


def verdicts(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """The worst verdict of each session's issues; VALID without any."""
    own = found.groupBy("session_id").agg(worst(F.col("verdict"), VERDICT).alias("verdict"), F.count("*").alias("issues"))
    return sessions.select("session_id").distinct().join(own, "session_id", "left").select("session_id", F.coalesce("verdict", F.lit("VALID")).alias("verdict"), F.coalesce("issues", F.lit(0)).alias("issues"))


def support(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """Support of each metric of each session, lowered by its issues, with the codes that lowered it."""
    spark = sessions.sparkSession
    impacts = spark.createDataFrame([(i, m, s) for i, metrics in IMPACTS.items() for m, s in metrics.items()], "impact string, metric string, lowered string")
    base = sessions.select("session_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in METRICS], "metric string")))  # eight rows
    first = found.groupBy("session_id", "code", "impact").agg(F.min("ord").alias("ord"))
    hit = first.join(F.broadcast(impacts), "impact").groupBy("session_id", "metric").agg(F.max(rank(F.col("lowered"), SUPPORT)).alias("r"), F.transform(F.sort_array(F.collect_set(F.struct("ord", "code"))), lambda x: x["code"]).alias("reasons"))
    return base.join(hit, ["session_id", "metric"], "left").select("session_id", "metric", unrank(F.coalesce("r", F.lit(0)), SUPPORT).alias("support"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def trusted(quantities: DataFrame, judged: DataFrame, include_untrusted: bool = False) -> DataFrame:
    """Quantities of VALID sessions only; others only when asked for."""
    return quantities if include_untrusted else quantities.join(judged.where("verdict = 'VALID'").select("session_id"), "session_id", "left_semi")
