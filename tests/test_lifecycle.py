"""Known answers for task events, coverage and clock anchors."""

from spanloom.operators import coverage, lifecycle

CONTEXTS = [("s", "A", "task-a", "task", "main_a", None), ("s", "B", "task-b", "task", "main_b", None), ("s", "idle", "idle", "idle", None, None), ("s", "I", "isr-1", "isr", "handler", 3), ("s", "J", "isr-2", "isr", None, 1)]


def given(spark, events):
    rows = spark.createDataFrame([("s", 0, i + 1, 10 * i, n, e) for i, (n, e) in enumerate(events)], "session_id string, core_id bigint, ord bigint, ts_ns bigint, name string, event string")
    contexts = spark.createDataFrame(CONTEXTS, "session_id string, name string, context_id string, kind string, entry_function_id string, priority int")
    return rows, contexts, spark.createDataFrame([("s", "R", "run_r"), ("s", "Q", "run_q")], "session_id string, name string, function_id string")


def kinds(spark, events):
    return [(r["type"], r["context_id"] or r["next_context_id"] or r["interrupt_id"]) for r in lifecycle.task_observations(*given(spark, events)).orderBy("ord").collect()]


def bad(spark, events):
    return [(r["ord"], r["violation"]) for r in lifecycle.judged(*given(spark, events)).where("violation IS NOT NULL").orderBy("ord").collect()]


def test_a_whole_life(spark):
    events = [("A", "activate"), ("A", "schedule"), ("A", "start"), ("R", "runnablestart"), ("I", "isrstart"), ("J", "isrstart"), ("J", "isrend"), ("I", "isrend"), ("R", "runnablestop"), ("A", "wait"), ("idle", "switch"), ("A", "switch"), ("A", "stop"), ("A", "terminate")]
    assert bad(spark, events) == []
    assert kinds(spark, events) == [
        ("Instant", "task-a"), ("ContextSwitch", "task-a"), ("FunctionEnter", "task-a"), ("FunctionEnter", "task-a"), ("InterruptEnter", "isr-1"), ("FunctionEnter", "isr-1"), ("InterruptEnter", "isr-2"), ("InterruptExit", "isr-2"),
        ("FunctionExit", "isr-1"), ("InterruptExit", "isr-1"), ("FunctionExit", "task-a"), ("Instant", "task-a"), ("ContextSwitch", "idle"), ("ContextSwitch", "task-a"), ("FunctionExit", "task-a"), ("Instant", "task-a"),
    ]


def test_frames_pair(spark):
    events = [("A", "switch"), ("R", "runnablestart"), ("Q", "runnablestart"), ("Q", "runnablestop"), ("R", "runnablestop"), ("I", "isrstart"), ("I", "isrend")]
    rows = lifecycle.task_observations(*given(spark, events)).orderBy("ord").collect()
    assert [r["frame_id"] for r in rows if r["type"].startswith("Function")] == ["frame:2", "frame:3", "frame:3", "frame:2", "frame:6", "frame:6"]
    assert {r["activation_id"] for r in rows if r["type"].startswith("Interrupt")} == {"isr-1:6"}


def test_unknown_left_boundary_stays_an_instant(spark):
    assert kinds(spark, [("A", "resume"), ("B", "switch"), ("B", "switch")]) == [("Instant", "task-a"), ("ContextSwitch", "task-b"), ("Instant", "task-b")]


def test_contradictions(spark):
    assert bad(spark, [("A", "activate"), ("A", "resume")]) == [(2, "wrong_state")]
    assert bad(spark, [("A", "activate"), ("A", "activate")]) == [(2, "activated_twice")]
    assert bad(spark, [("A", "switch"), ("B", "wait")]) == [(2, "not_scheduled")]
    assert bad(spark, [("A", "switch"), ("I", "isrstart"), ("J", "isrend")]) == [(3, "out_of_nesting")]
    assert bad(spark, [("A", "switch"), ("R", "runnablestop")]) == [(2, "stopped_without_start")]
    assert bad(spark, [("X", "switch"), ("A", "nonsense")]) == [(1, "unmapped_name"), (2, "unknown_event")]
    assert kinds(spark, [("A", "switch"), ("A", "stop"), ("A", "start")]) == [("ContextSwitch", "task-a")]


def test_coverage(spark):
    captures = spark.createDataFrame([("b1", "m1", s) for s in ("cold", "warm") * 5] + [("b1", "m2", "cold")], "board string, mode string, initial_state string")
    boards, modes = spark.createDataFrame([("b1",), ("b2",)], "board string"), ["m1", "m2"]
    got = {(r["board"], r["mode"]): (r["captures"], r["missing_states"], r["covered"]) for r in coverage.capture_coverage(captures, boards, modes, ["cold", "warm"]).collect()}
    assert got == {("b1", "m1"): (10, [], True), ("b1", "m2"): (1, ["warm"], False), ("b2", "m1"): (0, ["cold", "warm"], False), ("b2", "m2"): (0, ["cold", "warm"], False)}


def test_clock_anchors(spark):
    rows = spark.createDataFrame([("s", "x", 1, 100), ("s", "y", 7, 350)], "session_id string, source_id string, source_seq bigint, ts_ns bigint")
    anchors = spark.createDataFrame([("s", "near", "x", 1, "y", 7, 248), ("s", "far", "x", 1, "y", 7, 200), ("s", "lost", "x", 2, "y", 7, 1)], "session_id string, anchor string, a_source string, a_seq bigint, b_source string, b_seq bigint, expected_ns bigint")
    assert {r["anchor"]: (r["measured_ns"], r["ok"]) for r in coverage.clock_anchors(rows, anchors, 5).collect()} == {"near": (250, True), "far": (250, False), "lost": (None, False)}


def test_static_ram(spark):
    row = lambda n: [("s", *range(n, n + 6), 100)]
    schema = "session_id string, data_bytes bigint, bss_bytes bigint, noinit_bytes bigint, dma_bytes bigint, rtos_bytes bigint, custom_bytes bigint, total_bytes bigint"
    got = {r["kind"]: r["delta"] for r in coverage.compare_static_ram(spark.createDataFrame(row(0), schema), spark.createDataFrame(row(2), schema), ["session_id"]).collect()}
    assert got == {**dict.fromkeys(("data", "bss", "noinit", "dma", "rtos", "custom"), 2.0), "total": 0.0}
