"""Call activations, CPU time and call depth from ordered observations.

Rows carry ``session_id``, ``ord`` (strictly increasing in stream order), ``type``, ``ts_ns``, ``core_id``
and the columns of their type; ``replay`` lists them. Everything is a function of stream order, never of time
alone. What calls did comes from one replay of each session; everything after it is grouping and windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.scalar import QUALITY, rank, unrank
from spanloom.functions.tables import kept
from spanloom.operators import replay

FUNCTION = ("FunctionEnter", "FunctionExit")


def function_spans(observations: DataFrame, dealt: bool = False, ordered: bool = False) -> DataFrame:
    """One row for each activation: elapsed, active, self and preempted time, parent and quality."""
    return replay.spans(replay.replay(observations, kinds=("span",), dealt=dealt, ordered=ordered))


def hotspots(spans: DataFrame, by_context: bool = False) -> DataFrame:
    """Totals of the complete activations of each function; the average is the whole quotient."""
    keys = ["session_id", "function_id", *(["context_id"] if by_context else [])]
    out = spans.where("NOT incomplete").groupBy(*keys).agg(
        F.count("*").alias("activations"),
        F.sum("active_ns").alias("inclusive_ns"),
        F.sum("self_ns").alias("self_ns"),
        F.min("active_ns").alias("min_ns"),
        F.max("active_ns").alias("max_ns"),
        F.max(rank(F.col("quality"), QUALITY)).alias("q"),
    )
    return out.withColumn("average_ns", F.expr("inclusive_ns div activations")).withColumn("quality", unrank(F.col("q"), QUALITY)).drop("q")


def context_cpu(observations: DataFrame, dealt: bool = False, ordered: bool = False) -> DataFrame:
    """CPU time of each public context; all activations of an interrupt fold together."""
    return replay.contexts(replay.replay(observations, kinds=("cpu",), dealt=dealt, ordered=ordered))


def cpu_totals(contexts: DataFrame) -> DataFrame:
    """Task, interrupt and idle time of each session."""
    return contexts.groupBy("session_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("active_ns"))), F.lit(0)).alias(f"{k}_ns") for k in ("task", "isr", "idle")])


def deepest_path(spans: DataFrame) -> DataFrame:
    """Greatest depth of a session, and the root-to-leaf functions when it was first reached.

    Activations are read twice, so what is needed of them is written once.
    """
    spans = kept(spans.select("session_id", "ord", "context_id", "depth", "core_id", "ctx_kind", "function_id"), "spans", unsized=True)
    first = spans.groupBy("session_id").agg(F.max_by(F.struct("ord", "context_id", "depth", "core_id", "ctx_kind"), F.struct("depth", -F.col("ord"))).alias("deep"))
    opened = spans.join(first, "session_id").where("ord <= deep.ord AND depth <= deep.depth AND context_id <=> deep.context_id AND core_id <=> deep.core_id AND ctx_kind = deep.ctx_kind")
    latest = opened.groupBy("session_id", "deep", "depth").agg(F.max_by("function_id", "ord").alias("function_id"))
    return latest.groupBy("session_id", "deep").agg(F.sort_array(F.collect_list(F.struct("depth", "function_id"))).alias("path")).select("session_id", F.col("deep.depth").alias("max_depth"), F.col("deep.context_id").alias("context_id"), F.transform("path", lambda p: p["function_id"]).alias("path"))


def top_functions(found: DataFrame, n: int) -> DataFrame:
    """The n first functions of each session: own time, inclusive time, count, then id."""
    order = Window.partitionBy("session_id").orderBy(F.desc("self_ns"), F.desc("inclusive_ns"), F.desc("activations"), "function_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def incomplete_counts(spans: DataFrame) -> DataFrame:
    """Activations of each session, and how many of them are incomplete."""
    return spans.groupBy("session_id").agg(F.count("*").alias("spans"), F.count_if("incomplete").alias("incomplete_spans"))


def activation_counts(observations: DataFrame) -> DataFrame:
    """How often each task was switched to, and each interrupt entered."""
    rows = observations.where(F.col("type").isin("ContextSwitch", "InterruptEnter"))
    named = rows.select("session_id", F.coalesce("next_context_id", "interrupt_id").alias("context_id"), F.when(F.col("type") == "ContextSwitch", "task").otherwise("isr").alias("kind"))
    return named.groupBy("session_id", "context_id", "kind").agg(F.count("*").alias("activations"))
