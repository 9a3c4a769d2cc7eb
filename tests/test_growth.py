"""Work and memory that must not grow faster than the input."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa

from spanloom.operators import health, replay, reports
from spanloom.plans import adapters as A

DATA = "/root/testdata/sf0.001"


def switches(n: int) -> pa.Table:
    """Switches of three tasks on two cores of one capture."""
    at = np.arange(n)
    tasks = np.random.default_rng(3).integers(0, 3, n)
    return pa.table({"session_id": ["m"] * n, "ord": at, "ts_ns": at * 10, "source_id": ["p"] * n, "type": ["ContextSwitch"] * n, "core_id": at // 3 % 2, "next_context_id": [f"t{x}" for x in tasks]})


def found(table: pa.Table, **more) -> list[dict]:
    return pa.Table.from_batches(list(replay.replayed(iter(table.to_batches(max_chunksize=10_000)), **more))).to_pylist()


def test_overlaps_of_a_long_capture_are_not_quadratic():
    began = time.perf_counter()
    rows = found(switches(100_000))
    assert time.perf_counter() - began < 8
    own = sorted((r["context_id"], r["active_ns"]) for r in rows if r["kind"] == "cpu")
    assert own == sorted((r["context_id"], r["active_ns"]) for r in found(switches(100_000), chunk=5_000) if r["kind"] == "cpu")
    assert [r["context_id"] for r in rows if r["code"] == "concurrent_context"].count("t0") == 1


def test_returns_without_a_call_below_a_deep_stack_are_not_quadratic():
    n = 30_000
    names = [f"f{i}" for i in range(n)] + ["ghost"] * n
    table = pa.table({"session_id": ["s"] * 2 * n, "ord": np.arange(2 * n), "ts_ns": np.arange(2 * n), "source_id": ["p"] * 2 * n, "type": ["FunctionEnter"] * n + ["FunctionExit"] * n, "core_id": np.zeros(2 * n, np.int64), "context_id": ["t"] * 2 * n, "function_id": names})
    began = time.perf_counter()
    rows = found(table)
    assert time.perf_counter() - began < 8
    assert sum(r["code"] == "unmatched_function_exit" for r in rows) == n


def test_kinds_leave_the_other_rows_out(spark):
    every = replay.replay(A.busy_trace(spark, DATA))
    for kind in ("span", "cpu", "fact"):
        some = replay.replay(A.busy_trace(spark, DATA), kinds=(kind,), dealt=True)
        assert some.where(f"kind <> '{kind}'").isEmpty()
        assert some.exceptAll(every.where(f"kind = '{kind}'")).isEmpty() and every.where(f"kind = '{kind}'").exceptAll(some).isEmpty()


def test_captures_are_counted_by_their_replay(spark):
    rows = A.busy_trace(spark, DATA)
    due = rows.groupBy("session_id").count()
    for chunk in (50, 200_000):
        got = replay.sessions(replay.replay(rows, chunk=chunk, kinds=replay.KINDS))
        assert got.exceptAll(due).isEmpty() and due.exceptAll(got).isEmpty()


def test_an_analysis_reads_its_observations_once(spark):
    analysis = reports.analyze(A.busy_trace(spark, DATA), dealt=True)
    for part in (analysis.verdicts, analysis.counts, analysis.support):
        assert "lineitem" not in part._jdf.queryExecution().optimizedPlan().toString()


def test_capped_facts_are_found_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    facts = spark.range(10).selectExpr("'s' AS session_id", "id AS ord", "'trace_gap' AS code").mapInArrow(tell, "session_id string, ord bigint, code string")
    assert health.capped(facts, 4).count() == 4
    assert seen.value == 10


def test_tasks_stay_as_large_when_a_table_grows(spark, monkeypatch):
    monkeypatch.setattr(A, "TASK_ROWS", {"lineitem": 100, "orders": 100})
    lines, orders = A.parts(spark, DATA, "lineitem"), A.parts(spark, DATA, "orders")
    assert lines > 50 and orders > 14
    assert A.busy_trace(spark, DATA).rdd.getNumPartitions() == lines
    from spanloom.plans.registry import QUERIES

    assert "RepartitionByExpression [session_id#" in (plan := QUERIES["task_event_counts"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()) and f"], {orders}" in plan


def test_rows_in_order_are_neither_dealt_nor_sorted_again(spark):
    for trace in (A.busy_trace, A.call_trace):
        rows = trace(spark, DATA)
        every, some = replay.replay(rows), replay.replay(rows, ordered=True)
        assert some.exceptAll(every).isEmpty() and every.exceptAll(some).isEmpty()
        assert "Sort [session_id" not in some._jdf.queryExecution().optimizedPlan().toString()


def test_a_timeline_reads_no_marks_where_there_are_none(spark):
    from spanloom.operators import timeline

    rows = A.busy_trace(spark, DATA).selectExpr("*", "CAST(NULL AS BIGINT) AS source_seq")
    assert "Union" not in timeline.observation_events(rows)._jdf.queryExecution().optimizedPlan().toString()


def test_batches_are_sized_again_after_a_narrow_table_is_kept(spark):
    from spanloom.functions.tables import BATCH_BYTES, UNSIZED, kept, unsized_batches

    given = spark.conf.get(BATCH_BYTES)
    with unsized_batches(spark):
        assert spark.conf.get(BATCH_BYTES) == UNSIZED
    assert spark.conf.get(BATCH_BYTES) == given
    assert kept(spark.range(3), "three", unsized=True).count() == 3 and spark.conf.get(BATCH_BYTES) == given
    spark.conf.set(BATCH_BYTES, "1000000b")
    try:
        with unsized_batches(spark):
            pass
        assert spark.conf.get(BATCH_BYTES) == "1000000b"
    finally:
        spark.conf.unset(BATCH_BYTES)


def test_lines_are_sorted_once(spark):
    for trace in (A.busy_trace, A.call_trace):
        plan = trace(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("- Sort [o_custkey") == 1 and plan.count("Window [") == 2


def test_both_readings_of_a_trace_share_one_shuffle(spark):
    rows = A.busy_trace(spark, DATA)
    both = rows.groupBy("type").count().unionByName(rows.groupBy("type").agg({"ts_ns": "sum"}).toDF("type", "count"))
    both.collect()
    assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()


def test_diagnostics_are_counted_as_an_analysis_counts_them(spark, monkeypatch):
    monkeypatch.setattr(health.capped, "__defaults__", (3,))
    monkeypatch.setattr(health, "MOST_FACTS", 3)
    rows = A.busy_trace(spark, DATA)
    got, due = reports.diagnostics(rows, ordered=True), reports.analyze(rows, ordered=True).counts
    assert got.columns == due.columns and not got.where("facts > issues").isEmpty()
    assert got.exceptAll(due).isEmpty() and due.exceptAll(got).isEmpty()


def test_a_track_number_is_found_once_for_each_name():
    import pandas as pd

    from spanloom.operators import timeline

    h = 0xCBF29CE484222325
    for byte in b"context\0t0":
        h = (h ^ byte) * 0x100000001B3 % 2**64
    began = time.perf_counter()
    got = timeline.stable_track.func(pd.Series(["context\0t0"] * 500_000))
    assert time.perf_counter() - began < 2
    assert set(got) == {timeline.FIRST_OTHER + h % timeline.NUMBERS}


def test_a_chunk_is_bounded_however_long_a_task():
    assert replay.CHUNK <= 100_000
    table = switches(150_000)
    assert sum(r["kind"] == "session" for r in found(table, kinds=("session",))) > 1
