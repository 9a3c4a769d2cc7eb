"""Task-event exports as observations: scheduling states, interrupts, runnables, and what contradicts them.

Rows carry ``session_id``, ``core_id``, ``ord``, ``ts_ns``, ``name`` and ``event``. ``contexts`` maps a name of
a session to ``context_id``, ``kind`` (task, idle or isr), ``entry_function_id`` and ``priority``; ``runnables``
maps a name to ``function_id``. All state is read by windows over one core or one context of a session.

A stack of interrupts or runnables is told by its running depth: the enter that belongs to an exit is the
last enter at the same depth. Serial numbers are the ``ord`` of the enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event words, and the state that a task must be in before some of them.
SCHEDULING = ("switch", "schedule", "resume", "release")
STATES = ("activate", "preempt", "wait", "terminate")
FRAMES = ("start", "stop", "isrstart", "isrend", "runnablestart", "runnablestop")
REQUIRED = {"schedule": "ready", "resume": "preempted", "release": "waiting"}
AFTER = {"switch": "running", "schedule": "running", "resume": "running", "release": "running", "activate": "ready", "preempt": "preempted", "wait": "waiting", "terminate": "terminated"}
UNKNOWN = "unknown"


def judged(rows: DataFrame, contexts: DataFrame, runnables: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows with their mapping, prior state, what is scheduled, open stacks, and ``violation`` (null: none).

    All windows are over captures, which are dealt once, into ``parts`` partitions where given: a task sorts its rows
    for several windows at once, so its memory goes with its rows.
    """
    core = Window.partitionBy("session_id", "core_id").orderBy("ord")
    upto, before = core.rowsBetween(Window.unboundedPreceding, 0), core.rowsBetween(Window.unboundedPreceding, -1)
    event = F.col("event")
    named = rows.join(contexts, ["session_id", "name"], "left").join(runnables.withColumnRenamed("function_id", "runnable_id"), ["session_id", "name"], "left")
    named = named.repartition(parts, "session_id") if parts else named

    schedules = event.isin(*SCHEDULING)
    leaves = event.isin("preempt", "wait", "terminate") & F.col("context_id").isNotNull()
    named = named.withColumn("previous", F.last(F.when(schedules, F.col("context_id")), ignorenulls=True).over(before))
    seen = F.last(F.when(schedules | leaves, F.struct(F.when(schedules, F.col("context_id")).alias("c"))), ignorenulls=True)
    named = named.withColumn("scheduled", seen.over(before)["c"]).withColumn("first", F.row_number().over(core) == 1)

    for what, enter, leave in (("isr", "isrstart", "isrend"), ("run", "runnablestart", "runnablestop")):
        depth = F.sum(F.when(event == enter, 1).when(event == leave, -1).otherwise(0)).over(upto)
        named = named.withColumn(f"{what}_depth", depth)
    isr_level = F.when(event == "isrend", F.col("isr_depth") + 1).otherwise(F.col("isr_depth"))
    named = named.withColumn("isr_level", isr_level)
    at_isr = Window.partitionBy("session_id", "core_id", "isr_level").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    named = named.withColumn("isr_top", F.when(F.col("isr_level") > 0, F.last(F.when(event == "isrstart", F.struct("ord", "context_id")), ignorenulls=True).over(at_isr)))
    named = named.withColumn("active", F.coalesce("isr_top.context_id", "scheduled"))
    run_level = F.when(event == "runnablestop", F.col("run_depth") + 1).when(event == "runnablestart", F.col("run_depth"))
    named = named.withColumn("run_level", run_level)
    at_run = Window.partitionBy("session_id", "core_id", "run_level").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    named = named.withColumn("run_top", F.when(F.col("run_level") > 0, F.last(F.when(event == "runnablestart", F.struct("ord", F.col("runnable_id").alias("f"), F.col("active").alias("c"), F.col("isr_top.ord").alias("a"))), ignorenulls=True).over(at_run)))

    frames = Window.partitionBy("session_id", "context_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("task_frame", F.last(F.when(event.isin("start", "stop"), F.struct(F.when(event == "start", F.col("ord")).alias("ord"))), ignorenulls=True).over(frames)["ord"])
    return _with_state(named).withColumn("violation", _violation())


def _with_state(named: DataFrame) -> DataFrame:
    """Add the state of the row's context before it; a switch makes the state of the context it leaves unknown."""
    after = F.try_element_at(F.create_map(*[F.lit(x) for pair in AFTER.items() for x in pair]), F.col("event"))
    own = F.struct(F.lit(0).alias("role"), F.col("context_id").alias("of"), F.when((F.col("kind") == "task") & F.col("event").isin(*AFTER), after).alias("sets"))
    left = F.when((F.col("event") == "switch") & (F.col("previous") != F.col("context_id")), F.struct(F.lit(1).alias("role"), F.col("previous").alias("of"), F.lit(UNKNOWN).alias("sets")))
    each = named.select("*", F.explode(F.array_compact(F.array(own, left))).alias("e")).select("*", "e.*").drop("e")
    order = Window.partitionBy("session_id", "of").orderBy("ord", "role").rowsBetween(Window.unboundedPreceding, -1)
    known = each.withColumn("state", F.coalesce(F.last("sets", ignorenulls=True).over(order), F.lit(UNKNOWN)))
    return known.where("role = 0").drop("role", "of", "sets")


def _violation() -> Column:
    event, kind, state = F.col("event"), F.col("kind"), F.col("state")
    required = F.try_element_at(F.create_map(*[F.lit(x) for pair in REQUIRED.items() for x in pair]), event)
    runs = event.isin("runnablestart", "runnablestop")
    unnamed = (event == "preempt") & (F.col("name") == "") & F.col("first")
    leaves = event.isin("preempt", "wait", "terminate")
    inactive = F.col("scheduled").isNull() | (F.col("scheduled") != F.col("context_id"))
    return (
        F.when(~event.isin(*SCHEDULING, *STATES, *FRAMES), "unknown_event")
        .when(unnamed, None)
        .when(runs & F.col("runnable_id").isNull(), "unmapped_runnable")
        .when(~runs & F.col("context_id").isNull(), "unmapped_name")
        .when((event == "switch") & ~kind.isin("task", "idle"), "wrong_kind")
        .when(event.isin(*REQUIRED, *STATES, "start", "stop") & (kind != "task"), "wrong_kind")
        .when(event.isin("isrstart", "isrend") & (kind != "isr"), "wrong_kind")
        .when((state != UNKNOWN) & (required != state), "wrong_state")
        .when((event == "activate") & (state != UNKNOWN), "activated_twice")
        .when(leaves & inactive, "not_scheduled")
        .when((event == "start") & inactive, "not_scheduled")
        .when((event == "start") & F.col("task_frame").isNotNull(), "started_twice")
        .when((event == "start") & F.col("entry_function_id").isNull(), "no_entry_function")
        .when((event == "stop") & (inactive | (F.col("isr_depth") > 0)), "not_scheduled")
        .when((event == "stop") & F.col("task_frame").isNull(), "stopped_without_start")
        .when((event == "isrend") & F.col("isr_top").isNull(), "ended_without_start")
        .when((event == "isrend") & (F.col("isr_top.context_id") != F.col("context_id")), "out_of_nesting")
        .when((event == "runnablestart") & F.col("active").isNull(), "no_active_context")
        .when((event == "runnablestop") & F.col("run_top").isNull(), "stopped_without_start")
        .when((event == "runnablestop") & (F.col("run_top.f") != F.col("runnable_id")), "out_of_nesting")
        .when((event == "runnablestop") & ~(F.col("run_top.c").eqNullSafe(F.col("active")) & F.col("run_top.a").eqNullSafe(F.col("isr_top.ord"))), "outside_its_context")
    )


def task_observations(rows: DataFrame, contexts: DataFrame, runnables: DataFrame, parts: int | None = None) -> DataFrame:
    """Observations of the rows before the first violation of their session; ``parts`` as for ``judged``.

    A scheduling word whose task's earlier state is unknown, or that schedules what already ran, stays an
    instant. Interrupt rows with an entry function give two observations.
    """
    found = judged(rows, contexts, runnables, parts)
    first = F.min(F.when(F.col("violation").isNotNull(), F.col("ord"))).over(Window.partitionBy("session_id"))
    good = found.withColumn("first_bad", first).where("first_bad IS NULL OR ord < first_bad")
    event = F.col("event")
    text = F.lit(None).cast("string")

    def out(step: int, kind: str, **columns: Column) -> Column:
        names = ("context_id", "function_id", "frame_id", "prev_context_id", "next_context_id", "interrupt_id", "activation_id", "name")
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("type"), *[columns.get(n, text).cast("string").alias(n) for n in names])

    switches = event.isin(*SCHEDULING) & ((event == "switch") | (F.col("state") != UNKNOWN)) & ~F.col("previous").eqNullSafe(F.col("context_id"))
    frame = lambda n: F.concat(F.lit("frame:"), n.cast("string"))
    activation = F.concat(F.col("isr_top.context_id"), F.lit(":"), F.col("isr_top.ord").cast("string"))
    task = {"context_id": F.col("context_id"), "function_id": F.col("entry_function_id")}
    isr = {"interrupt_id": F.col("context_id"), "activation_id": activation}
    entry = F.col("entry_function_id").isNotNull()
    run = {"context_id": F.col("active"), "function_id": F.col("runnable_id"), "frame_id": frame(F.col("run_top.ord"))}
    instant = event.isin(*STATES) | (event.isin(*SCHEDULING) & ~switches)
    each = F.array(
        F.when(switches, out(0, "ContextSwitch", prev_context_id=F.col("previous"), next_context_id=F.col("context_id"))),
        F.when(instant, out(0, "Instant", context_id=F.col("context_id"), name=F.concat(F.lit("taskevents."), event))),
        F.when(event == "start", out(0, "FunctionEnter", frame_id=frame(F.col("ord")), **task)),
        F.when(event == "stop", out(0, "FunctionExit", frame_id=frame(F.col("task_frame")), **task)),
        F.when(event == "isrstart", out(0, "InterruptEnter", **isr)),
        F.when((event == "isrstart") & entry, out(1, "FunctionEnter", frame_id=frame(F.col("isr_top.ord")), **task)),
        F.when((event == "isrend") & entry, out(0, "FunctionExit", frame_id=frame(F.col("isr_top.ord")), **task)),
        F.when(event == "isrend", out(1, "InterruptExit", **isr)),
        F.when(event == "runnablestart", out(0, "FunctionEnter", **run)),
        F.when(event == "runnablestop", out(0, "FunctionExit", **run)),
    )
    return good.select("session_id", "core_id", F.col("ord").alias("row"), "ts_ns", "priority", F.explode(F.array_compact(each)).alias("o")).select("session_id", "core_id", (F.col("row") * 2 + F.col("o.step")).alias("ord"), "ts_ns", "priority", "o.*").drop("step")
