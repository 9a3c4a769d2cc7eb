"""Known answers for call activations."""

from spanloom.operators import replay, traces

SCHEMA = "session_id string, ord bigint, source_id string, source_seq bigint, quality string, type string, ts_ns bigint, core_id bigint, context_id string, function_id string, next_context_id string, interrupt_id string, activation_id string, span_id string, correlation_id string, duration_ns bigint"


def rows(spark, events, session="s"):
    data = []
    for i, (kind, ts, extra) in enumerate(events):
        data.append((session, i, "src", i, "exact", kind, ts, extra.get("core", 0) if kind != "TraceGap" else None, extra.get("ctx"), extra.get("fn"), extra.get("next"), extra.get("irq"), extra.get("act"), extra.get("span"), extra.get("corr"), extra.get("dur")))
    return spark.createDataFrame(data, SCHEMA)


def by_function(df):
    return {r["function_id"]: r.asDict() for r in df.collect()}


#: A call whose inner call an interrupt delays, and which waits while another task runs.
NESTED = [
    ("ContextSwitch", 0, {"next": "worker"}),
    ("FunctionEnter", 3, {"ctx": "worker", "fn": "root"}),
    ("FunctionEnter", 14, {"ctx": "worker", "fn": "child"}),
    ("InterruptEnter", 19, {"irq": "timer"}),
    ("FunctionEnter", 20, {"ctx": "timer", "fn": "handler"}),
    ("FunctionExit", 31, {"ctx": "timer", "fn": "handler"}),
    ("InterruptExit", 33, {"irq": "timer"}),
    ("FunctionExit", 40, {"ctx": "worker", "fn": "child"}),
    ("ContextSwitch", 47, {"next": "idle"}),
    ("ContextSwitch", 70, {"next": "worker"}),
    ("FunctionExit", 75, {"ctx": "worker", "fn": "root"}),
]


def test_interrupt_and_suspension(spark):
    got = by_function(traces.function_spans(rows(spark, NESTED)))
    assert (got["root"]["elapsed_ns"], got["root"]["active_ns"], got["root"]["preempted_ns"], got["root"]["self_ns"]) == (72, 35, 37, 23)
    assert (got["child"]["elapsed_ns"], got["child"]["active_ns"], got["child"]["self_ns"]) == (26, 12, 12)
    assert (got["handler"]["elapsed_ns"], got["handler"]["active_ns"]) == (11, 11)
    assert got["child"]["parent_ord"] == got["root"]["ord"] and got["handler"]["parent_ord"] is None
    assert not any(r["incomplete"] for r in got.values())


def test_cpu_by_context(spark):
    found = traces.context_cpu(rows(spark, NESTED))
    assert {r["context_id"]: (r["kind"], r["active_ns"]) for r in found.collect()} == {"worker": ("task", 38), "timer": ("isr", 14), "idle": ("idle", 23)}
    assert traces.cpu_totals(found).collect()[0].asDict() == {"session_id": "s", "task_ns": 38, "isr_ns": 14, "idle_ns": 23}


def test_gap_and_open_call_are_incomplete(spark):
    events = [("FunctionEnter", 0, {"ctx": "t", "fn": "a"}), ("FunctionEnter", 5, {"ctx": "t", "fn": "b"}), ("TraceGap", 6, {"dur": 4}), ("FunctionExit", 15, {"ctx": "t", "fn": "b"}), ("FunctionEnter", 20, {"ctx": "t", "fn": "c"})]
    got = by_function(traces.function_spans(rows(spark, events)))
    assert got["b"]["incomplete"] and got["b"]["active_ns"] == 6 and got["b"]["quality"] == "inferred"
    assert got["a"]["incomplete"] and got["c"]["incomplete"]


def test_incomplete_child_marks_parent(spark):
    """The inner call is spoiled by a return in the wrong order of another; its caller returns in order, and is incomplete too."""
    call = lambda kind, ts, fn: (kind, ts, {"ctx": "t", "fn": fn})
    events = [call("FunctionEnter", 0, "outer"), call("FunctionEnter", 2, "inner"), call("FunctionEnter", 3, "leaf"), call("FunctionExit", 7, "inner"), call("FunctionEnter", 8, "sound"), call("FunctionExit", 9, "sound"), call("FunctionExit", 12, "outer")]
    spans = traces.function_spans(rows(spark, events))
    got = by_function(spans)
    assert {f: r["incomplete"] for f, r in got.items()} == {"outer": True, "inner": True, "leaf": True, "sound": False}
    assert got["leaf"]["end_ns"] == 7 and got["outer"]["self_ns"] == 6 and got["outer"]["quality"] == "inferred"
    assert {r["function_id"] for r in traces.hotspots(spans).collect()} == {"sound"}
    assert traces.deepest_path(spans).collect()[0]["path"] == ["outer", "inner", "leaf"]


def test_missing_exit_and_unmatched_exit(spark):
    call = lambda kind, ts, fn: (kind, ts, {"ctx": "t", "fn": fn})
    found = replay.replay(rows(spark, [call("FunctionEnter", 0, "a"), call("FunctionEnter", 1, "b"), call("FunctionExit", 5, "a"), call("FunctionEnter", 6, "d"), call("FunctionExit", 8, "d"), call("FunctionExit", 9, "a")]))
    got = by_function(replay.spans(found))
    assert {f: (r["start_ns"], r["end_ns"], r["self_ns"], r["depth"], r["incomplete"]) for f, r in got.items()} == {"a": (0, 5, 1, 1, True), "b": (1, 5, 4, 2, True), "d": (6, 8, 2, 1, False)}
    assert [(r["code"], r["start_ns"]) for r in replay.facts(found).orderBy("ord").collect()] == [("mismatched_function_exit", 5), ("unmatched_function_exit", 9)]


def test_interrupts_pair_by_activation(spark):
    irq = lambda kind, ts, name, act: (kind, ts, {"irq": name, "act": act})
    events = [("ContextSwitch", 0, {"next": "t"}), irq("InterruptEnter", 1, "x", "1"), irq("InterruptEnter", 3, "y", "2"), irq("InterruptExit", 4, "x", "9"), irq("InterruptExit", 6, "x", "1"), irq("InterruptEnter", 7, "x", "3"), ("ContextSwitch", 9, {"next": "u"})]
    found = replay.replay(rows(spark, events))
    assert sorted(r["code"] for r in replay.facts(found).collect()) == ["mismatched_interrupt_exit", "unclosed_interrupt", "unmatched_interrupt_exit"]
    got = [(r["interrupt_id"], r["depth"], r["interrupted_ord"], r["preempted_context_id"], r["start_ns"], r["end_ns"], r["active_ns"], r["incomplete"]) for r in replay.interrupts(found).orderBy("ord").collect()]
    assert got == [("x", 1, None, "t", 1, 6, 2, True), ("y", 2, 1, "t", 3, 6, 3, True), ("x", 1, None, "u", 7, 9, 2, True)]


def test_duplicate_activation_and_brackets(spark):
    irq = lambda kind, ts: (kind, ts, {"irq": "x", "act": "1"})
    mark = lambda kind, ts, key: (kind, ts, {"corr": key, "span": key, "core": 0})
    events = [irq("InterruptEnter", 0), irq("InterruptEnter", 1), irq("InterruptExit", 2), irq("InterruptExit", 3), mark("SpanBegin", 4, "p"), mark("SpanBegin", 5, "p"), mark("SpanEnd", 6, "p"), mark("SpanEnd", 7, "p"), mark("AsyncBegin", 8, "q"), mark("AsyncEnd", 9, "z")]
    found = replay.replay(rows(spark, events))
    assert [r["code"] for r in replay.facts(found).orderBy("ord", "code").collect() if r["code"] != "missing_scheduled_context"] == ["duplicate_interrupt_activation", "duplicate_span_begin", "unmatched_span_end", "unmatched_async_end", "unclosed_async"]
    assert [(r["form"], r["start_ns"], r["end_ns"], r["incomplete"]) for r in replay.brackets(found).orderBy("ord").collect()] == [("sync", 4, 6, False), ("async", 8, 9, True)]


def test_one_task_on_two_cores(spark):
    events = [("ContextSwitch", 0, {"next": "t", "core": 0}), ("ContextSwitch", 2, {"next": "t", "core": 1}), ("ContextSwitch", 10, {"next": "v", "core": 1}), ("ContextSwitch", 12, {"next": "u", "core": 0})]
    found = replay.replay(rows(spark, events))
    assert [r["code"] for r in replay.facts(found).collect()] == ["concurrent_context"]
    assert {r["context_id"]: r["active_ns"] for r in replay.contexts(found).collect()} == {"t": 12, "v": 2}


def test_calls_of_another_context(spark):
    events = [("ContextSwitch", 0, {"next": "t"}), ("FunctionEnter", 1, {"ctx": "t", "fn": "a"}), ("FunctionEnter", 2, {"ctx": "u", "fn": "b"}), ("FunctionExit", 5, {"ctx": "u", "fn": "b"}), ("FunctionExit", 6, {"ctx": "t", "fn": "a"})]
    found = replay.replay(rows(spark, events))
    assert {r["code"] for r in replay.facts(found).collect()} == {"context_mismatch"}
    assert all(r["incomplete"] for r in replay.spans(found).collect())
    assert by_function(replay.spans(replay.replay(rows(spark, events), switches=False)))["b"]["active_ns"] == 3


def test_many_sessions_in_a_task(spark):
    """State is a session's own, whatever the batches and tasks."""
    every = None
    for k in range(7):
        one = rows(spark, NESTED, f"s{k}")
        every = one if every is None else every.unionByName(one)
    got = traces.function_spans(every.orderBy("ts_ns")).groupBy("function_id").count().collect()
    assert {r["function_id"]: r["count"] for r in got} == {"root": 7, "child": 7, "handler": 7}


def test_two_cores_do_not_share_time(spark):
    events = [("FunctionEnter", 0, {"ctx": "t", "fn": "a", "core": 0}), ("FunctionEnter", 2, {"ctx": "u", "fn": "b", "core": 1}), ("FunctionExit", 10, {"ctx": "t", "fn": "a", "core": 0}), ("FunctionExit", 12, {"ctx": "u", "fn": "b", "core": 1})]
    got = by_function(traces.function_spans(rows(spark, events)))
    assert got["a"]["active_ns"] == 10 and got["b"]["active_ns"] == 10


def test_empty(spark):
    assert traces.hotspots(traces.function_spans(spark.createDataFrame([], SCHEMA))).count() == 0
