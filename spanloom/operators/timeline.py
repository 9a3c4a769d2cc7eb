"""Captures as timeline events for trace viewers: one row an event, tracks at first use, one JSON document a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from spanloom.functions.scalar import async_id, ns_as_us
from spanloom.functions.tables import kept

#: Tracks of one purpose, the first track of a core, and the first of everything else.
GAPS, METADATA, UNATTRIBUTED, DIAGNOSTICS = 1, 2, 3, 4
FIRST_CORE, FIRST_OTHER = 16, 1024
#: How many numbers there are for everything else.
NUMBERS = (1 << 31) - 1 - FIRST_OTHER
#: Phase and category of each kind of observation.
PHASES = {
    "ContextSwitch": ("i", "scheduler"), "InterruptEnter": ("B", "interrupt"), "InterruptExit": ("E", "interrupt"), "Sample": ("i", "sample"), "Counter": ("C", "counter"), "TraceGap": ("X", "trace_gap"), "Metadata": ("i", "metadata"),
    "Instant": ("i", "custom"), "SpanBegin": ("B", "custom_span"), "SpanEnd": ("E", "custom_span"), "AsyncBegin": ("b", "async"), "AsyncEnd": ("e", "async"), "FunctionEnter": ("B", "function_event"), "FunctionExit": ("E", "function_event"),
}


@F.pandas_udf(IntegerType())
def stable_track(owner: pd.Series) -> pd.Series:
    """A track number that depends on its owner's name alone: FNV-1a of 64 bits, once for each distinct name of a batch."""
    found = {}
    for name in set(owner):  # not by pandas, which reads a name up to its first NUL only
        h = 0xCBF29CE484222325
        for byte in name.encode():
            h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        found[name] = FIRST_OTHER + h % NUMBERS
    return pd.Series([found[name] for name in owner], dtype="int32")


def observation_events(observations: DataFrame, raw_calls: bool = False) -> DataFrame:
    """An event for each observation; calls are left to their spans unless ``raw_calls``.

    Of brackets, only ends that go with an open begin are drawn, under the name of their begin.
    """
    need = {"function_id": "string", "address": "bigint", "value": "double", "counter_id": "string", "name": "string", "key": "string", "span_id": "string", "correlation_id": "string", "activation_id": "string", "prev_context_id": "string", "reason": "string"}
    rows = observations.withColumns({c: F.lit(None).cast(t) for c, t in need.items() if c not in observations.columns})
    rows = rows.where(F.col("type").isin(list(PHASES)))
    if not raw_calls:
        rows = rows.where(~F.col("type").isin("FunctionEnter", "FunctionExit"))
    rows = _paired(rows)
    kind = F.col("type")
    phase = F.create_map(*[F.lit(x) for k, (p, _) in PHASES.items() for x in (k, p)])
    category = F.create_map(*[F.lit(x) for k, (_, c) in PHASES.items() for x in (k, c)])
    bracket = kind.isin("SpanBegin", "SpanEnd", "AsyncBegin", "AsyncEnd")
    name = (
        F.when(kind == "ContextSwitch", "Context switch").when(kind.isin("InterruptEnter", "InterruptExit"), F.col("interrupt_id")).when(kind == "Sample", F.coalesce("function_id", F.lit("PC sample"))).when(kind == "Counter", F.col("counter_id"))
        .when(kind == "TraceGap", "Trace gap").when(kind == "Metadata", "Source metadata").when(kind.isin("FunctionEnter", "FunctionExit"), F.col("function_id")).when(bracket, F.col("begin_name")).otherwise(F.col("name"))
    )
    args = F.to_json(F.struct("source_id", "source_seq", "quality", F.col("prev_context_id").alias("previous_context"), F.col("next_context_id").alias("next_context"), "activation_id", "span_id", "correlation_id", "function_id", F.concat(F.lit("0x"), F.lower(F.hex("address"))).alias("address"), "value", "reason", "key"))
    owner = (
        F.when(kind == "TraceGap", _fixed(GAPS, "Trace gaps")).when(kind == "Metadata", _fixed(METADATA, "Source metadata")).when(kind.isin("InterruptEnter", "InterruptExit"), _interrupt(F.col("core_id"), F.col("interrupt_id")))
        .when((kind != "ContextSwitch") & F.col("context_id").isNotNull(), _context(F.col("context_id"))).when(F.col("core_id").isNotNull(), _core(F.col("core_id"))).otherwise(_fixed(UNATTRIBUTED, "Unattributed events"))
    )
    return rows.select(
        "session_id", F.lit(1).alias("part"), "ord", phase[kind].alias("ph"), category[kind].alias("cat"), name.alias("name"), "ts_ns", F.when(kind == "TraceGap", F.col("duration_ns")).alias("dur_ns"),
        F.when(kind.isin("AsyncBegin", "AsyncEnd"), async_id(F.col("source_id"), F.col("correlation_id"))).alias("id"), owner.alias("owner"), args.alias("args"),
    )


def _paired(rows: DataFrame) -> DataFrame:
    """Add ``begin_name``; drop brackets that repeat a begin or end nothing."""
    kind = F.col("type")
    # of equalities, so that where rows are made of other types the optimizer drops this reading of them
    sync = (kind == "SpanBegin") | (kind == "SpanEnd")
    both = sync | (kind == "AsyncBegin") | (kind == "AsyncEnd")
    begin = F.col("type").isin("SpanBegin", "AsyncBegin")
    order = Window.partitionBy("session_id", "source_id", sync, F.when(sync, F.struct("core_id", "context_id", "span_id")), F.when(~sync, F.col("correlation_id"))).orderBy("ord")
    marks = rows.where(both).withColumn("before", F.lag(F.struct(begin.alias("begin"), "name")).over(order))
    # a begin after a begin is a repeat, and an end after an end has none to go with; what follows a repeat is still the first's
    shown = marks.where(F.when(begin, ~F.coalesce(F.col("before.begin"), F.lit(False))).otherwise(F.coalesce(F.col("before.begin"), F.lit(False))))
    named = shown.withColumn("begin_name", F.when(begin, F.col("name")).otherwise(F.last(F.when(begin, F.col("name")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return rows.where(~both).withColumn("begin_name", F.lit(None).cast("string")).unionByName(named.drop("before"))


def span_events(spans: DataFrame) -> DataFrame:
    """A complete event for each activation."""
    args = F.to_json(F.struct("active_ns", "core_id", "self_ns", "preempted_ns", "quality", "incomplete", "function_id", "source_id", "source_seq_start", "source_seq_end"))
    owner = F.when(F.col("ctx_kind") == "isr", _interrupt(F.col("core_id"), F.col("context_id"))).otherwise(_context(F.col("context_id")))
    return spans.select("session_id", F.lit(0).alias("part"), "ord", F.lit("X").alias("ph"), F.lit("function").alias("cat"), F.col("function_id").alias("name"), F.col("start_ns").alias("ts_ns"), F.col("elapsed_ns").alias("dur_ns"), F.lit(None).cast("string").alias("id"), owner.alias("owner"), args.alias("args"))


def health_events(verdicts: DataFrame) -> DataFrame:
    """A warning at the start of each capture that is not VALID."""
    bad = verdicts.where("verdict <> 'VALID'")
    return bad.select("session_id", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("ord"), F.lit("i").alias("ph"), F.lit("health").alias("cat"), F.concat(F.lit("Capture health: "), "verdict").alias("name"), F.lit(0).cast("bigint").alias("ts_ns"), F.lit(None).cast("bigint").alias("dur_ns"), F.lit(None).cast("string").alias("id"), _fixed(DIAGNOSTICS, "Diagnostics").alias("owner"), F.to_json(F.struct("verdict")).alias("args"))


def _owner(kind: str, key: Column, label: Column, fixed: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), label.cast("string").alias("label"), fixed.cast("int").alias("fixed"))


def _fixed(track: int, label: str) -> Column:
    return _owner("fixed", F.lit(label), F.lit(label), F.lit(track))


def _core(core: Column) -> Column:
    return _owner("core", core, F.concat(F.lit("Core "), core.cast("string"), F.lit(" scheduler")), core + FIRST_CORE)


def _context(context: Column) -> Column:
    return _owner("context", context, context, F.lit(None))


def _interrupt(core: Column, interrupt: Column) -> Column:
    return _owner("interrupt", F.concat(core.cast("string"), F.lit("/"), interrupt), F.concat(interrupt, F.lit(" (Core "), core.cast("string"), F.lit(")")), F.lit(None))


def tracks(events: DataFrame, numbers: int = NUMBERS) -> DataFrame:
    """session_id, owner and track of every track used, and the place of its first event; no two owners share a number.

    A number depends on the owner's name; where it is taken, the owner takes the next free one, in the order of first
    use, beyond the last of ``numbers`` the first again. All owners try at once, round by round: of those that meet in
    a number the earliest keeps it and the others go on, which ends as if they had come one after another.
    """
    # the first place by numbers alone, as the least struct is found by sorting all events
    used = events.groupBy("session_id", "owner", "part").agg(F.min("ord").alias("ord")).groupBy("session_id", "owner").agg(F.min(F.struct("part", "ord")).alias("first"))
    own = F.coalesce("owner.fixed", F.lit(FIRST_OTHER) + (stable_track(F.concat("owner.kind", F.lit("\0"), F.coalesce("owner.key", F.lit("")))) - FIRST_OTHER) % numbers)
    left = used.withColumn("track", own.cast("int"))
    met = Window.partitionBy("session_id", "track").orderBy(F.col("owner.fixed").isNull(), "first", "owner.kind", "owner.key")
    for _ in range(numbers):
        placed = left.withColumn("place", F.row_number().over(met))
        moved = F.lit(FIRST_OTHER) + (F.col("track") - FIRST_OTHER + 1) % numbers
        step = kept(placed.withColumn("track", F.when(F.col("place") > 1, moved).otherwise(F.col("track")).cast("int")), "tracks", unsized=True)
        left = step.drop("place")
        if step.where("place > 1").isEmpty():
            return left
    raise RuntimeError(f"a capture has more than {numbers} tracks")


def timeline(events: DataFrame) -> DataFrame:
    """Every event and, before the first event of a track, its name: session_id, seq and the event as JSON.

    Spans come first, then observations in stream order.
    """
    known = tracks(events)
    placed = events.join(known.select("session_id", "owner", "track"), ["session_id", "owner"])
    head = F.struct("part", "ord", F.lit(0).alias("step"))
    names = known.select("session_id", F.struct("first.part", "first.ord", F.lit(0).alias("step")).alias("at"), F.to_json(F.struct(F.lit("thread_name").alias("name"), F.lit("M").alias("ph"), F.lit(1).alias("pid"), F.col("track").alias("tid"), F.struct(F.col("owner.label").alias("name")).alias("args"))).alias("event"))
    args = F.from_json("args", "map<string,string>")
    body = F.to_json(F.struct("name", "cat", "ph", ns_as_us(F.col("ts_ns")).cast("decimal(22,3)").alias("ts"), ns_as_us(F.col("dur_ns")).cast("decimal(22,3)").alias("dur"), F.lit(1).alias("pid"), F.col("track").alias("tid"), "id", args.alias("args")))
    shown = placed.select("session_id", head.withField("step", F.lit(1)).alias("at"), body.alias("event"))
    order = Window.partitionBy("session_id").orderBy("at", "event")
    return names.unionByName(shown).withColumn("seq", F.row_number().over(order)).select("session_id", "seq", "event")


def write_timeline(lines: DataFrame, path: str) -> None:
    """One JSON document for each session, in a folder of its own."""
    rows = lines.select("session_id", "seq", F.concat(F.when(F.col("seq") > 1, ",").otherwise(""), "event").alias("value"))
    ends = lines.select("session_id").distinct()
    rows = rows.unionByName(ends.select("session_id", F.lit(0).alias("seq"), F.lit('{"traceEvents":[').alias("value"))).unionByName(ends.select("session_id", F.lit(2**31 - 1).alias("seq"), F.lit("]}").alias("value")))
    rows.repartition("session_id").sortWithinPartitions("session_id", "seq").select("session_id", "value").write.partitionBy("session_id").text(path)
