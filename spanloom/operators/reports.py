"""Reports on whole captures: analysis, summaries with their first rows, session inventory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.scalar import QUALITY, SUPPORT, rank, share_of, unrank
from spanloom.functions.tables import kept
from spanloom.operators import counters, health, replay, samples, traces


@dataclass
class Analysis:
    """What ``analyze`` finds; all parts are DataFrames with a session_id."""

    spans: DataFrame
    interrupts: DataFrame
    brackets: DataFrame
    facts: DataFrame
    issues: DataFrame
    verdicts: DataFrame
    support: DataFrame
    hotspots: DataFrame
    contexts: DataFrame
    totals: DataFrame
    counters: DataFrame
    sampling: DataFrame
    counts: DataFrame


def analyze(observations: DataFrame, path: str | None = None, capabilities: DataFrame | None = None, include_untrusted: bool = False, dealt: bool = False, ordered: bool = False) -> Analysis:
    """Replay captures and derive everything that one pass over them tells.

    Captures are replayed once: the replay is written, under ``path`` where one is given, and all parts read it, which
    captures there are and how long they are, too. ``dealt`` and ``ordered``: as for a replay.
    Quantities are those of VALID captures, unless asked for; the activations of a DEGRADED one are inferred at best.
    """
    found = kept(replay.replay(observations, kinds=replay.KINDS, dealt=dealt, ordered=ordered), "replay", path, unsized=True)
    values = [c for c in ("counter_id", "value", "behaviour", "whole") if c in observations.columns]
    measured = counters.checked(observations.where("type = 'Counter'")) if len(values) == 4 else None
    own = replay.facts(found).select("session_id", "ord", "code")
    if measured is not None:
        own = own.unionByName(measured.where("violation IS NOT NULL").select("session_id", "ord", F.col("violation").alias("code")))
    issues = health.issues(health.capped(own))
    counted = replay.sessions(found)
    sessions = counted.select("session_id")
    verdicts = health.verdicts(sessions, issues)
    spans = replay.spans(found)
    hotspots = gated(traces.hotspots(spans), verdicts, include_untrusted)
    support = health.support(sessions, issues)
    if capabilities is not None:
        support = with_capabilities(support, capabilities)
    address = F.col("address") if "address" in observations.columns else F.lit(None).cast("bigint")
    weight = F.col("weight_ns") if "weight_ns" in observations.columns else F.lit(None).cast("bigint")
    sampled = observations.where("type = 'Sample'").select("session_id", "function_id", address.alias("address"), "context_id", weight.alias("weight_ns"))
    return Analysis(
        spans, replay.interrupts(found), replay.brackets(found), replay.facts(found), issues, verdicts, support, hotspots, replay.contexts(found), traces.cpu_totals(replay.contexts(found)),
        counters.summary(measured) if measured is not None else sessions.where("false"), samples.sampling_hotspots(sampled), diagnostic_counts(counted, spans, own, issues),
    )


def gated(hotspots: DataFrame, verdicts: DataFrame, include_untrusted: bool = False) -> DataFrame:
    """Totals of captures that can be trusted: none of INVALID ones; of DEGRADED ones as inferred."""
    kept = hotspots.join(verdicts.select("session_id", "verdict"), "session_id")
    kept = kept if include_untrusted else kept.where("verdict <> 'INVALID'")
    lowered = F.greatest(rank(F.col("quality"), QUALITY), F.when(F.col("verdict") == "VALID", 0).otherwise(1))
    return kept.withColumn("quality", unrank(lowered, QUALITY)).drop("verdict")


def diagnostic_counts(observations: DataFrame, spans: DataFrame, facts: DataFrame, issues: DataFrame) -> DataFrame:
    """Observations, activations, incomplete ones, facts and issues of each session; ``observations`` may be counted already."""
    counted = observations if "observations" in observations.columns else observations.groupBy("session_id").agg(F.count("*").alias("observations"))
    out = counted.join(traces.incomplete_counts(spans), "session_id", "left")
    for name, df in (("facts", facts), ("issues", issues)):
        out = out.join(df.groupBy("session_id").agg(F.count("*").alias(name)), "session_id", "left")
    return out.fillna(0)


def diagnostics(observations: DataFrame, dealt: bool = False, ordered: bool = False) -> DataFrame:
    """The counts of ``analyze`` alone, by one grouping of the replay, of which nothing else is written.

    Each fact that ``capped`` keeps is one issue, so their number follows from that of the facts.
    """
    found = replay.replay(observations, kinds=("session", "span", "fact"), dealt=dealt, ordered=ordered).select("session_id", "kind", "ord", "incomplete")
    if {"counter_id", "value", "behaviour", "whole"} <= set(observations.columns):
        broken = counters.checked(observations.where("type = 'Counter'")).where("violation IS NOT NULL")
        found = found.unionByName(broken.select("session_id", F.lit("fact").alias("kind"), "ord", F.lit(None).cast("boolean").alias("incomplete")))
    span, fact = F.col("kind") == "span", F.col("kind") == "fact"
    out = found.groupBy("session_id").agg(
        F.sum(F.when(F.col("kind") == "session", F.col("ord"))).alias("observations"), F.count_if(span).alias("spans"), F.count_if(span & F.col("incomplete")).alias("incomplete_spans"), F.count_if(fact).alias("facts"),
    )
    return kept(out.withColumn("issues", F.least("facts", F.lit(health.MOST_FACTS))), "diagnostics", unsized=True)


#: Which metrics each family of a capture's declared abilities bears on.
FAMILIES = {
    "function_events": ("wall_time", "active_time", "self_time", "call_count"),
    "context_switches": ("active_time", "self_time", "context_time"),
    "interrupt_events": ("active_time", "self_time", "interrupt_time"),
    "samples": ("sampling",),
    "counters": ("resource",),
}


def capabilities(receipts: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, family, support, reasons of each family, from ``receipts(session_id, family, support, reasons)``.

    Families that bear on nothing are ignored; a session without a receipt can do nothing, for that reason.
    """
    wide = sessions.select("session_id").distinct().crossJoin(F.broadcast(sessions.sparkSession.createDataFrame([(f,) for f in FAMILIES], "family string")))  # five rows
    both = wide.join(receipts.withColumn("given", F.lit(True)), ["session_id", "family"], "left").join(receipts.select("session_id", F.lit(True).alias("receipt")).distinct(), "session_id", "left")
    missing = F.array(F.concat(F.lit("capture_receipt_missing:"), "family"))
    unsaid = F.array(F.concat(F.lit("capability_undeclared:"), "family"))
    reasons = F.when(F.col("receipt").isNull(), missing).when(F.col("given").isNull(), unsaid).otherwise(F.coalesce("reasons", F.array().cast("array<string>")))
    return both.select("session_id", "family", F.when(F.col("given"), F.col("support")).otherwise("unavailable").alias("support"), reasons.alias("reasons"))


def with_capabilities(support: DataFrame, declared: DataFrame) -> DataFrame:
    """Support that no metric exceeds what its families can do; reasons of abilities come first, each once."""
    bears = support.sparkSession.createDataFrame([(f, m, i) for i, (f, metrics) in enumerate(FAMILIES.items()) for m in metrics], "family string, metric string, place int")
    # calls without schedule or interrupts are still inferred, not unavailable
    level = rank(F.col("support"), SUPPORT)
    soft = F.col("family").isin("context_switches", "interrupt_events") & F.col("metric").isin("active_time", "self_time")
    due = declared.join(F.broadcast(bears), "family").select("session_id", "metric", "place", F.when(soft & (level == len(SUPPORT) - 1), 1).otherwise(level).alias("due"), "reasons")
    held = due.groupBy("session_id", "metric").agg(F.max("due").alias("due"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "reasons"))), lambda x: x["reasons"])).alias("first"))
    both = support.join(held, ["session_id", "metric"], "left")
    worst = F.greatest(rank(F.col("support"), SUPPORT), F.coalesce("due", F.lit(0)))
    every = F.array_distinct(F.concat(F.coalesce("first", F.array().cast("array<string>")), "reasons"))
    return both.select("session_id", "metric", unrank(worst, SUPPORT).alias("support"), every.alias("reasons"))


def resource_support(declared: DataFrame, summaries: DataFrame) -> DataFrame:
    """What the counters of a session support: as declared, lowered by the worst quality seen; unavailable without any."""
    seen = summaries.groupBy("session_id").agg(F.max(rank(F.col("quality"), QUALITY)).alias("worst"))
    both = declared.where("family = 'counters'").join(seen, "session_id", "left")
    level = F.when(F.col("worst").isNull(), len(SUPPORT) - 1).otherwise(F.greatest(rank(F.col("support"), SUPPORT), F.col("worst")))
    return both.select("session_id", unrank(level, SUPPORT).alias("support"))


def report_order(hotspots: DataFrame) -> DataFrame:
    """Place of each function of a session: own time, then id."""
    order = Window.partitionBy("session_id").orderBy(F.desc("self_ns"), "function_id")
    return hotspots.withColumn("place", F.row_number().over(order))


def top_sampled(sampled: DataFrame, n: int) -> DataFrame:
    """The n first sampled places of each session: count, share, then identity."""
    order = Window.partitionBy("session_id").orderBy(F.desc("samples"), F.desc("share"), F.asc_nulls_last("function_id"), F.asc_nulls_last("address"), F.asc_nulls_last("context_id"))
    return sampled.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def top_contexts(contexts: DataFrame, n: int) -> DataFrame:
    """The n busiest tasks and the n busiest interrupts of each session, with their share of all CPU time."""
    order = Window.partitionBy("session_id", "kind").orderBy(F.desc("active_ns"), "context_id")
    total = F.sum("active_ns").over(Window.partitionBy("session_id"))
    return contexts.withColumn("share", share_of(F.col("active_ns"), total)).withColumn("place", F.row_number().over(order)).where(F.col("kind").isin("task", "isr") & (F.col("place") <= n))


def top_counters(summaries: DataFrame, n: int) -> DataFrame:
    """The n first counters of each group (what ``counters.SEMANTICS`` calls the class, else other), by id."""
    known = summaries.sparkSession.createDataFrame([(s, c) for s, _, _, c, _, _ in counters.SEMANTICS], "counter_id string, class string")
    grouped = summaries.join(F.broadcast(known), "counter_id", "left").withColumn("group", F.coalesce("class", F.lit("other"))).drop("class")
    order = Window.partitionBy("session_id", "group").orderBy("counter_id")
    return grouped.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def top_paths(folded: DataFrame, n: int) -> DataFrame:
    """The n most sampled stacks of each session, with their share."""
    order = Window.partitionBy("session_id").orderBy(F.desc("samples"), "termination", "path")
    total = F.sum("samples").over(Window.partitionBy("session_id"))
    return folded.withColumn("share", share_of(F.col("samples"), total)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def summary(found: Analysis, top: int = 10, most_issues: int = 64, most_reasons: int = 8) -> dict[str, DataFrame]:
    """The first rows of every part of an analysis, and its diagnostics up to fixed numbers."""
    order = Window.partitionBy("session_id").orderBy("ord", "code")
    listed = found.issues.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_issues)
    return {
        "verdicts": found.verdicts,
        "counts": found.counts,
        "totals": found.totals,
        "functions": traces.top_functions(found.hotspots, top),
        "contexts": top_contexts(found.contexts, top),
        "sampling": top_sampled(found.sampling, top),
        "counters": top_counters(found.counters, top) if "counter_id" in found.counters.columns else found.counters,
        "issues": listed,
        "support": found.support.withColumn("reasons", F.slice("reasons", 1, most_reasons)),
    }


def session_inventory(sessions: DataFrame, verdicts: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row a session: its verdict, whether its quantities are trusted, and which parts have rows of it."""
    out = sessions.select("session_id").distinct().join(verdicts.select("session_id", "verdict"), "session_id", "left")
    for name, df in parts.items():
        out = out.join(df.select("session_id", F.lit(True).alias(f"has_{name}")).distinct(), "session_id", "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    trust = F.when(F.col("verdict") == "VALID", "trusted").when(F.col("verdict").isNull(), "not_analyzed").otherwise("untrusted")
    return out.withColumn("trust", trust)
