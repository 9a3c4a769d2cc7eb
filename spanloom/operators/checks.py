"""Contracts of what enters and leaves the operators: each function gives the rows that break one, with the first reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.scalar import QUALITY, SEVERITY, SUPPORT, rank


def _first(df: DataFrame, keys: list[str], *rules: tuple[str, Column]) -> DataFrame:
    reason = None
    for name, broken in rules:
        reason = F.when(broken, name) if reason is None else reason.when(broken, name)
    return df.select(*keys, reason.alias("violation")).where("violation IS NOT NULL")


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def dictionary_violations(entries: DataFrame) -> DataFrame:
    """Entries (session_id, kind, id, name, line) without id or name, with a line below 1, or whose id is taken."""
    many = F.count("*").over(Window.partitionBy("session_id", "kind", "id"))
    return _first(entries.withColumn("many", many), ["session_id", "kind", "id"], ("empty_id", _blank("id")), ("empty_name", _blank("name")), ("line_below_one", F.col("line") < 1), ("duplicate_id", F.col("many") > 1))


def counter_definition_violations(definitions: DataFrame, semantics: DataFrame) -> DataFrame:
    """Counters whose meaning and subject do not go together.

    ``definitions``: session_id, counter_id, unit, semantic, subject_kind, subject, role, context_kind. ``semantics`` is
    ``counters.semantics``.
    """
    known = semantics.select("semantic", F.col("unit").alias("due_unit"), F.col("subject_kind").alias("due_kind"))
    rows = definitions.join(known, "semantic", "left").withColumn("many", F.count("*").over(Window.partitionBy("session_id", "semantic", "subject")))
    meant, named = F.col("semantic").isNotNull(), F.col("subject").isNotNull()
    return _first(
        rows, ["session_id", "counter_id"],
        ("semantic_without_subject", meant & ~named), ("subject_without_semantic", named & ~meant), ("unit_mismatch", F.col("due_unit").isNotNull() & ~F.col("unit").eqNullSafe(F.col("due_unit"))),
        ("subject_kind_mismatch", F.col("due_kind").isNotNull() & ~F.col("subject_kind").eqNullSafe(F.col("due_kind"))),
        ("stack_role_mismatch", (F.col("role") == "task") & (F.col("context_kind") != "task") | (F.col("role") == "isr") & (F.col("context_kind") != "isr")),
        ("duplicate_subject", meant & (F.col("many") > 1)),
    )


def span_violations(spans: DataFrame) -> DataFrame:
    """Activations whose times do not add up."""
    exact = (F.col("quality") == QUALITY[0]) & ~F.col("incomplete")
    parts = F.col("active_ns") + F.col("preempted_ns")
    return _first(
        spans, ["session_id", "ord", "function_id"],
        ("sequence_range", F.col("source_seq_end") < F.col("source_seq_start")), ("bounds", F.col("end_ns") < F.col("start_ns")), ("elapsed", F.col("elapsed_ns") != F.col("end_ns") - F.col("start_ns")),
        ("parts_exceed_elapsed", parts > F.col("elapsed_ns")), ("parts_below_elapsed", exact & (parts != F.col("elapsed_ns"))), ("self_exceeds_active", F.col("self_ns") > F.col("active_ns")),
    )


def hotspot_violations(hotspots: DataFrame) -> DataFrame:
    """Totals that no set of activations can have."""
    return _first(
        hotspots, ["session_id", "function_id"],
        ("no_activations", F.col("activations") <= 0), ("average_out_of_range", ~F.col("average_ns").between(F.col("min_ns"), F.col("max_ns"))),
        ("average_mismatch", F.col("average_ns") != F.expr("inclusive_ns div greatest(activations, 1)")), ("self_exceeds_inclusive", F.col("self_ns") > F.col("inclusive_ns")),
    )


def label_violations(labels: DataFrame, buckets: DataFrame, most: int = 10, widest: int = 4) -> DataFrame:
    """Debugger labels (session_id, place, bucket, low, high, hits) that do not name the fullest part of a bucket."""
    order = Window.partitionBy("session_id").orderBy("place")
    known = buckets.select("session_id", F.col("start").alias("bucket"), F.col("end").alias("bucket_end"), F.col("hits").alias("bucket_hits"))
    rows = labels.withColumn("before", F.lag("hits").over(order)).join(known, ["session_id", "bucket"], "left")
    return _first(
        rows, ["session_id", "place"],
        ("too_many_labels", F.col("place") > most), ("unknown_bucket", F.col("bucket_end").isNull()), ("not_sorted", F.col("hits") > F.col("before")), ("outside_bucket", (F.col("low") < F.col("bucket")) | (F.col("high") > F.col("bucket_end"))),
        ("empty_or_wide", (F.col("high") <= F.col("low")) | (F.col("high") - F.col("low") > widest)), ("more_hits_than_bucket", F.col("hits") > F.col("bucket_hits")),
    )


def report_violations(verdicts: DataFrame, issues: DataFrame, support: DataFrame) -> DataFrame:
    """Health reports whose verdict does not cover their issues, or whose lowered support has no reason or one twice."""
    worst = issues.groupBy("session_id").agg(F.max(rank(F.col("severity"), SEVERITY)).alias("worst"))
    lowered = (rank(F.col("support"), SUPPORT) > 0) & (F.size("reasons") == 0)
    twice = F.size(F.array_distinct("reasons")) < F.size("reasons")
    flags = support.groupBy("session_id").agg(F.bool_or(lowered).alias("silent"), F.bool_or(twice).alias("twice"))
    rows = verdicts.join(worst, "session_id", "left").join(flags, "session_id", "left")
    grave = F.coalesce("worst", F.lit(0))
    return _first(
        rows, ["session_id"],
        ("verdict_below_severity", (grave >= 2) & (F.col("verdict") != "INVALID") | (grave == 1) & (F.col("verdict") == "VALID")),
        ("support_without_reason", F.coalesce("silent", F.lit(False))), ("repeated_reason", F.coalesce("twice", F.lit(False))),
    )


def resource_violations(summaries: DataFrame) -> DataFrame:
    """Counter summaries (``counters.summary``) that cannot be compared."""
    return _first(
        summaries, ["session_id", "counter_id"],
        ("no_values", F.col("n") <= 0), ("window", F.col("last_ts_ns") < F.col("first_ts_ns")), ("extremes", (F.col("least") > F.col("greatest")) | ~F.col("first").between(F.col("least"), F.col("greatest")) | ~F.col("latest").between(F.col("least"), F.col("greatest"))),
        ("delta", F.col("delta").isNotNull() & (F.col("delta") != F.col("latest") - F.col("first"))), ("rate_of_no_monotonic", F.col("rate_per_s").isNotNull() & ~F.col("behaviour").eqNullSafe("monotonic")),
    )


def count_violations(observations: DataFrame, declared: DataFrame) -> DataFrame:
    """Sources whose rows are not as many as ``declared(session_id, source_id, expected)``."""
    found = observations.groupBy("session_id", "source_id").agg(F.count("*").alias("found"))
    both = declared.join(found, ["session_id", "source_id"], "full").withColumns({"found": F.coalesce("found", F.lit(0))})
    return both.where(~F.col("expected").eqNullSafe(F.col("found"))).select("session_id", "source_id", "expected", "found")


def core_coverage(observations: DataFrame, declared: DataFrame) -> DataFrame:
    """Sessions whose cores are not those of ``declared(session_id, cores)``, as sets."""
    found = observations.where("core_id IS NOT NULL").groupBy("session_id").agg(F.array_sort(F.collect_set("core_id")).alias("found"))
    both = declared.select("session_id", F.array_sort(F.array_distinct("cores")).alias("cores")).join(found, "session_id", "left")
    return both.withColumn("found", F.coalesce("found", F.array().cast("array<bigint>"))).where("cores <> found")


def once(facts: DataFrame, by: list[str]) -> DataFrame:
    """The first of the facts that agree in the named columns."""
    order = Window.partitionBy(*by).orderBy("ord")
    return facts.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def unknown_ids(rows: DataFrame, dictionary: DataFrame, column: str, kind: str) -> DataFrame:
    """Ids that no dictionary entry of their kind defines, with the rows that use them."""
    entries = dictionary.where(F.col("kind") == kind).select("session_id", F.col("id").alias(column))
    return rows.where(F.col(column).isNotNull()).join(entries, ["session_id", column], "left_anti").groupBy("session_id", column).agg(F.count("*").alias("rows"))


def shared_times(a: DataFrame, b: DataFrame) -> DataFrame:
    """Times at which both have rows."""
    return a.select("session_id", "ts_ns").intersect(b.select("session_id", "ts_ns"))


def named(rows: DataFrame, dictionary: DataFrame, column: str, kind: str, out: str) -> DataFrame:
    """Add the name that the dictionary gives an id, or the id itself."""
    entries = dictionary.where(F.col("kind") == kind).select("session_id", F.col("id").alias(column), F.col("name").alias("_name"))
    return rows.join(entries, ["session_id", column], "left").withColumn(out, F.coalesce("_name", column)).drop("_name")
