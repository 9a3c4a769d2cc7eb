"""Whether a set of captures covers what was asked for, and whether clocks and static memory agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.scalar import delta, outcome, relative

KINDS = ("data", "bss", "noinit", "dma", "rtos", "custom", "total")


def capture_coverage(captures: DataFrame, boards: DataFrame, modes: list[str], states: list[str], repetitions: int = 10) -> DataFrame:
    """A row for each board and mode: captures, missing initial states, and whether both suffice.

    Every one of ``boards`` is asked for every mode, so that absent pairs fail too.
    """
    wanted = boards.select("board").distinct().withColumn("mode", F.explode(F.lit(modes)))
    found = captures.groupBy("board", "mode").agg(F.count("*").alias("captures"), F.array_sort(F.collect_set("initial_state")).alias("seen"))
    both = wanted.join(found, ["board", "mode"], "left")
    missing = F.array_sort(F.array_except(F.lit(states).cast("array<string>"), F.coalesce("seen", F.array().cast("array<string>"))))
    rows = both.select("board", "mode", F.coalesce("captures", F.lit(0)).alias("captures"), missing.alias("missing_states"))
    return rows.withColumn("covered", (F.col("captures") >= repetitions) & (F.size("missing_states") == 0))


def missing_semantics(counters: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """Semantics that each subject lacks, by its kind; subjects with all of theirs give no row."""
    wanted = F.create_map(*[x for k, v in required.items() for x in (F.lit(k), F.lit(v))])
    seen = counters.groupBy("session_id", "subject_kind", "subject").agg(F.collect_set("semantic").alias("seen"))
    lacking = F.array_sort(F.array_except(F.try_element_at(wanted, F.col("subject_kind")), F.col("seen")))
    return seen.select("session_id", "subject_kind", "subject", lacking.alias("missing")).where(F.size("missing") > 0)


def missing_roles(counters: DataFrame, sessions: DataFrame, roles: list[str]) -> DataFrame:
    """Stack roles that no counter of a session has; sessions with all of them give no row, those without counters lack all."""
    seen = counters.where("subject_kind = 'stack'").groupBy("session_id").agg(F.collect_set("role").alias("seen"))
    both = sessions.select("session_id").distinct().join(seen, "session_id", "left")
    lacking = F.array_sort(F.array_except(F.lit(roles).cast("array<string>"), F.coalesce("seen", F.array().cast("array<string>"))))
    return both.select("session_id", lacking.alias("missing")).where(F.size("missing") > 0)


def clock_anchors(observations: DataFrame, anchors: DataFrame, tolerance_ns: int) -> DataFrame:
    """Each anchor's two observations: their times, the measured distance, and whether it is as expected.

    ``anchors``: session_id, anchor, a_source, a_seq, b_source, b_seq, expected_ns (b after a).
    """
    at = observations.select("session_id", F.col("source_id").alias("source"), F.col("source_seq").alias("seq"), "ts_ns")

    def end(side: str) -> DataFrame:
        return at.select("session_id", F.col("source").alias(f"{side}_source"), F.col("seq").alias(f"{side}_seq"), F.col("ts_ns").alias(f"{side}_ns"))

    found = anchors.join(end("a"), ["session_id", "a_source", "a_seq"], "left").join(end("b"), ["session_id", "b_source", "b_seq"], "left")
    measured = F.col("b_ns") - F.col("a_ns")
    close = F.coalesce(F.abs(measured - F.col("expected_ns")) <= tolerance_ns, F.lit(False))
    return found.select("session_id", "anchor", "a_ns", "b_ns", measured.alias("measured_ns"), "expected_ns", close.alias("ok"))


def compare_static_ram(baseline: DataFrame, candidate: DataFrame, keys: list[str], absolute: float = 0.0, share: float = 0.0) -> DataFrame:
    """Bytes of each kind on both sides, seven rows for each pair that has both."""
    sides = [df.select(*keys, F.struct(*[F.col(f"{k}_bytes") for k in KINDS]).alias(name)) for df, name in ((baseline, "b"), (candidate, "c"))]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"b.{k}_bytes").cast("double").alias("baseline"), F.col(f"c.{k}_bytes").cast("double").alias("candidate")) for k in KINDS]))
    rows = sides[0].join(sides[1], keys).select(*keys, each.alias("m")).select(*keys, "m.*")
    x, y = F.col("baseline"), F.col("candidate")
    return rows.withColumn("delta", delta(x, y)).withColumn("relative", relative(x, y)).withColumn("outcome", outcome(x, y, absolute, share))
