"""The streaming module over files that arrive in several batches."""

import random

import pytest

from spanloom.operators import replay
from spanloom.operators.replay import INPUT
from spanloom.streaming import live
from test_passes import WHOLE, capture


def arrivals(spark, folder, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def result(df, name, mode):
    asked = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    asked.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_running_counters(spark, tmp_path):
    rows = arrivals(spark, tmp_path, "session_id string, counter_id string, ord bigint, value double", [[("s", "c", 1, 5.0), ("s", "c", 2, 2.0)], [("s", "c", 3, 9.0)]])
    got = [r for r in result(live.live_counters(rows), "running_counters", "complete")]
    assert [(r["n"], r["first"], r["latest"], r["least"], r["greatest"]) for r in got] == [(3, 5.0, 9.0, 2.0, 9.0)]


def test_windows(spark, tmp_path):
    from datetime import datetime

    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    rows = arrivals(spark, tmp_path, "session_id string, counter_id string, time timestamp, value double", [[("s", "c", at(0), 1.0), ("s", "c", at(1), 3.0)], [("s", "c", at(59), 7.0)]])
    got = result(live.live_windows(rows, "time", "10 minutes", "5 minutes"), "windowed_counters", "append")
    assert [(r["n"], r["mean"]) for r in got] == [(2, 2.0)]


def test_replay_across_batches(spark, tmp_path):
    call = lambda i, kind, ts, f: ("s", i, "src", i, "exact", kind, ts, 0, "t", f)
    batches = [[call(1, "FunctionEnter", 0, "a"), call(2, "FunctionEnter", 5, "b")], [call(3, "FunctionExit", 9, "b"), call(4, "FunctionEnter", 9, "c"), call(5, "FunctionExit", 20, "a"), call(6, "FunctionEnter", 22, "d")], [("s", 7, None, None, None, "CaptureEnd", 30, None, None, None)]]
    rows = arrivals(spark, tmp_path, "session_id string, ord bigint, source_id string, source_seq bigint, quality string, type string, ts_ns bigint, core_id bigint, context_id string, function_id string", batches)
    got = result(live.live_replay(rows), "live_replay", "append")
    spans = {r["function_id"]: (r["depth"], r["start_ns"], r["end_ns"], r["active_ns"], r["incomplete"]) for r in got if r["kind"] == "span"}
    assert spans == {"a": (1, 0, 20, 20, True), "b": (2, 5, 9, 4, False), "c": (2, 9, 20, 11, True), "d": (1, 22, 30, 8, True)}
    assert [r["code"] for r in got if r["kind"] == "fact"] == ["mismatched_function_exit", "unclosed_function"]
    assert [(r["context_id"], r["active_ns"]) for r in got if r["kind"] == "cpu"] == [("t", 30)]


def test_running_hotspots(spark, tmp_path):
    schema = "session_id string, function_id string, active_ns bigint, self_ns bigint, quality string, incomplete boolean"
    rows = arrivals(spark, tmp_path, schema, [[("s", "f", 5, 2, "exact", False)], [("s", "f", 8, 3, "inferred", False), ("s", "f", 99, 9, "exact", True)]])
    got = result(live.live_hotspots(rows), "live_hotspots", "complete")
    assert [(r["activations"], r["inclusive_ns"], r["max_ns"], r["average_ns"], r["quality"]) for r in got] == [(2, 13, 8, 6, "inferred")]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


SCHEMA = "session_id string, " + ", ".join(f"{c} {'bigint' if c in WHOLE else 'string'}" for c in INPUT)


def rows_of(df):
    return sorted((tuple(r) for r in df), key=str)


def test_late_rows_wait_for_each_other(rocks, tmp_path):
    """Rows that arrive up to two batches late give the rows of the batch replay, in sessions that break every rule."""
    r = random.Random(11)
    start = 1_700_000_000_000_000_001  # no double holds it
    batches = [[] for _ in range(12)]
    whole = []
    for s in ("a", "b"):
        rows = capture(r, s, 300)
        for i, row in enumerate(rows):
            row["ts_ns"] += start
            batches[i // 30 + r.randrange(3)].append(tuple(row.values()))
        whole += rows
        end = max(x["ts_ns"] + (x["duration_ns"] or 0) for x in rows)
        batches[11].append(tuple({**dict.fromkeys(rows[0]), "session_id": s, "ord": 300, "type": "CaptureEnd", "ts_ns": end}.values()))
    rows = arrivals(rocks, tmp_path, SCHEMA, batches)
    got = rows_of(result(live.live_ordered(rows, 260), "late_rows", "append"))
    due = rows_of(replay.replay(rocks.createDataFrame([tuple(x.values()) for x in whole], SCHEMA)).collect())
    assert len(due) > 300
    assert got == due


def test_what_is_later_than_the_slack_is_told(rocks, tmp_path):
    call = lambda i, kind, ts, f: ("s", i, "src", i, "exact", kind, ts, 0, "t", f)
    batches = [[call(1, "FunctionEnter", 0, "a"), call(3, "FunctionEnter", 90, "b")], [call(4, "FunctionExit", 95, "b"), call(5, "FunctionExit", 200, "a")], [call(2, "FunctionEnter", 5, "late")], [("s", 7, None, None, None, "CaptureEnd", 230, None, None, None)]]
    rows = arrivals(rocks, tmp_path, "session_id string, ord bigint, source_id string, source_seq bigint, quality string, type string, ts_ns bigint, core_id bigint, context_id string, function_id string", batches)
    got = result(live.live_ordered(rows, 20), "too_late", "append")
    assert {"out_of_order_sequence", "out_of_order_timestamp"} <= {r["code"] for r in got if r["kind"] == "fact"}
    assert {r["function_id"] for r in got if r["kind"] == "span"} == {"a", "b", "late"}
