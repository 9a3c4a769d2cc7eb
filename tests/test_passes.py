"""Columnar replay: any cut of the rows gives the same rows; brackets, faults that rows name, tracks, cycles and strict files."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions.scalar import strict_json, strict_value
from spanloom.operators import catalog, health, replay, timeline
from spanloom.operators.passes import highest, nest
from spanloom.operators.replay import INPUT, replayed
from spanloom.sources import canonical

WHOLE = {"ord", "source_seq", "ts_ns", "core_id", "duration_ns"}
NAMES = ["session_id", *INPUT]


def capture(r, session, n):
    """Random rows, many of which break a rule."""
    rows, ts, seq = [], r.randrange(50), {}
    for i in range(n):
        kind = r.choices(["FunctionEnter", "FunctionExit", "ContextSwitch", "InterruptEnter", "InterruptExit", "TraceGap", "SpanBegin", "SpanEnd", "AsyncBegin", "AsyncEnd", "Instant"], [30, 28, 8, 6, 6, 1, 2, 2, 2, 2, 3])[0]
        ts += r.choice([0, 1, 2, 5]) - (r.randrange(12) if r.random() < 0.02 else 0)
        source = r.choice("ab")
        seq[source] = seq.get(source, 0) + (1 if r.random() < 0.97 else r.choice([0, 2, -1]))
        row = dict.fromkeys(NAMES) | {"session_id": session, "ord": i, "source_id": source, "source_seq": seq[source], "quality": r.choice(["exact", "inferred"]), "type": kind, "ts_ns": ts, "core_id": r.choice([0, 1])}
        if kind.startswith("Function"):
            row |= {"context_id": r.choice(["t0", "t1", "irq0"]), "function_id": r.choice("fgh"), "frame_id": r.choice(["x", None, None])}
        elif kind == "ContextSwitch":
            row |= {"next_context_id": r.choice(["t0", "t1", "idle"]), "prev_context_id": r.choice(["t0", None])}
        elif kind.startswith("Interrupt"):
            row |= {"interrupt_id": r.choice(["irq0", "irq1"]), "activation_id": r.choice(["1", "2", None])}
        elif kind == "TraceGap":
            row |= {"core_id": None, "duration_ns": r.randrange(6), "told": r.choice([None, "flow_error"])}
        elif kind.startswith(("Span", "Async")):
            row |= {"context_id": r.choice(["t0", None]), "core_id": r.choice([0, None]), "span_id": r.choice("12"), "correlation_id": r.choice("12"), "name": "n"}
        rows.append(row)
    return rows


def found(rows, chunk, each, switches):
    batches = [pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows[k : k + each]], pa.int64() if c in WHOLE else pa.string()) for c in NAMES}) for k in range(0, len(rows), each)]
    return sorted((tuple(x) for b in replayed(iter(batches), switches, chunk) for x in zip(*[c.to_pylist() for c in b.columns], strict=True)), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_any_cut_gives_the_same(seed):
    r = random.Random(seed)
    rows = [x for k in range(4) for x in capture(r, f"s{k}", r.choice([1, 30, 120]))]
    whole = found(rows, 10**6, 1000, seed % 2 == 0)
    assert len(whole) > 50
    for chunk, each in ((1, 9), (25, 7), (100, 40)):
        assert found(rows, chunk, each, seed % 2 == 0) == whole


def test_a_capture_in_parts_equals_its_parts_alone():
    """Captures do not touch each other, whatever chunk they share."""
    r = random.Random(77)
    parts = [capture(r, f"s{k}", 40) for k in range(5)]
    together = found([x for p in parts for x in p], 10**6, 33, True)
    assert together == sorted((x for p in parts for x in found(p, 10**6, 1000, True)), key=str)


def test_nest_by_depth_equals_nest_one_by_one():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 14)
        opens = np.array([r.random() < 0.55 for _ in range(n)])
        key = np.array([r.randrange(2) for _ in range(n)])
        got = nest(np.zeros(n, np.int64), opens, lambda a, b, key=key: key[a] == key[b])
        stack, match = [], [-1] * n
        for i in range(n):
            if opens[i]:
                stack.append(i)
            elif any(key[j] == key[i] for j in stack):
                while True:
                    j = stack.pop()
                    match[j] = i
                    if key[j] == key[i]:
                        match[i] = j
                        break
        assert got.match.tolist() == match


def test_highest_restarts_with_each_group():
    values, heads = np.array([3, 1, 5, 2, 9, -4, -7]), np.array([1, 0, 0, 1, 0, 1, 0], bool)
    assert highest(values, heads).tolist() == [3, 3, 5, 2, 9, -4, -4]


def test_reasons_and_metadata_make_a_capture_invalid(spark):
    schema = "session_id string, ord bigint, source_id string, type string, ts_ns bigint, duration_ns bigint, reason string, key string, value string"
    rows = [("gap", 1, "s", "TraceGap", 10, 5, "FIFO full", None, None), ("pause", 1, "s", "TraceGap", 10, 5, "operator paused", None, None), ("said", 1, "s", "Metadata", 3, None, None, "health.elf-match", "false"), ("fine", 1, "s", "Metadata", 3, None, None, "elf_match", "true")]
    observed = spark.createDataFrame(rows, schema)
    facts = replay.facts(replay.replay(observed))
    assert sorted((r["session_id"], r["code"], r["start_ns"], r["end_ns"]) for r in facts.collect()) == [("gap", "trace_gap", 10, 15), ("gap", "trace_overflow", 10, 15), ("pause", "trace_gap", 10, 15), ("said", "elf_mismatch", 3, 3)]
    judged = health.verdicts(observed, health.issues(facts))
    assert {r["session_id"]: r["verdict"] for r in judged.collect()} == {"gap": "INVALID", "pause": "DEGRADED", "said": "INVALID", "fine": "VALID"}


def test_issues_by_the_code_that_a_name_means(spark):
    facts = spark.createDataFrame([("s", 1, " Firmware-Mismatch"), ("s", 2, "trace gap")], "session_id string, ord bigint, code string")
    assert {(r["code"], r["severity"]) for r in health.issues(facts).collect()} == {("elf_mismatch", "fatal"), ("trace_gap", "warning")}


def test_tracks_are_never_shared(spark):
    rows = [("s", "x", f"c{k}", "m", k % 3, k) for k in range(12)] + [("t", "x", "c1", "m", 0, 1)]
    owner = F.struct(F.lit("context").alias("kind"), F.col("c").alias("key"), F.col("c").alias("label"), F.lit(None).cast("int").alias("fixed"))
    events = spark.createDataFrame(rows, "session_id string, name string, c string, m string, part int, ord int").withColumn("owner", owner)
    got = timeline.tracks(events, 12).collect()
    assert sorted(r["track"] for r in got if r["session_id"] == "s") == [*range(1024, 1036)]
    with pytest.raises(RuntimeError):
        timeline.tracks(events, 11)


def test_track_numbers_are_those_of_their_names(spark):
    due = {"ctx-0": 592576069, "ctx-1": 593101304, "ctx-10": 689074151, "ctx-11": 688548916, "ctx-12": 688023681}  # by the SQL of numbered_tracks
    got = timeline.stable_track.func(pd.Series([f"context\0{c}" for c in due]))
    assert [n - timeline.FIRST_OTHER for n in got] == [*due.values()]
    owner = F.struct(F.lit("context").alias("kind"), F.col("c").alias("key"), F.col("c").alias("label"), F.lit(None).cast("int").alias("fixed"))
    events = spark.createDataFrame([("s", c, 0, k) for k, c in enumerate(due)], "session_id string, c string, part int, ord int").withColumn("owner", owner)
    assert {r["owner"]["key"]: r["track"] - timeline.FIRST_OTHER for r in timeline.tracks(events).collect()} == due


def test_an_owner_without_a_name_has_a_track(spark):
    owner = F.struct(F.lit("interrupt").alias("kind"), F.col("c").alias("key"), F.col("c").alias("label"), F.lit(None).cast("int").alias("fixed"))
    rows = spark.createDataFrame([("s", None, 0, 1), ("t", "0/a", 0, 1), ("t", None, 0, 2)], "session_id string, c string, part int, ord int").withColumn("owner", owner)
    alone = timeline.tracks(rows.where("session_id = 's'")).collect()
    both = timeline.tracks(rows).where("owner.key IS NULL").collect()
    assert {r["track"] for r in alone} == {r["track"] for r in both} and None not in {r["track"] for r in both}


def test_only_members_of_cycles_are_named(spark):
    edges = [("b", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("g", "a"), ("e", "h")]
    got = catalog.cycles(spark.createDataFrame(edges, "a string, b string")).collect()
    assert {(r["node"], r["cycle"]) for r in got} == {("a", "b"), ("b", "b"), ("d", "e"), ("e", "e"), ("f", "f")}
    assert catalog.cycles(spark.createDataFrame([("x", "y"), ("y", "z")], "a string, b string")).collect() == []


def test_facts_beyond_the_limit(spark):
    rows = [("many", k, "c") for k in range(10)] + [("few", 1, "c"), (None, 1, "c")]
    got = health.capped(spark.createDataFrame(rows, "session_id string, ord bigint, code string"), 4).collect()
    assert sorted((r["session_id"] or "", r["ord"], r["code"], r["dropped"]) for r in got) == [("", 1, "c", None), ("few", 1, "c", None), ("many", 0, "c", None), ("many", 1, "c", None), ("many", 2, "c", None), ("many", 3, "diagnostics_truncated", 7)]


def test_strict_value_equals_the_parser(spark):
    texts = ['{"a":1}', '{"a":1,"a":2}', '{"a":{"b":1,"b":2}}', '{"a":[{"b":1,"b":2}]}', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}],[{}', '{"a":01}', '{"a":1,}', '{"\\u0061":2,"a":1}', "{'a':1}", "5", "null", "", " ", "[1]", None, '{"a":tru}', '{"a":"x"']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(strict_value(F.col("t")).alias("a"), strict_json(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and any(r["a"] for r in rows)


def lines_of(n, odd):
    yield '{"schema":"observations/1","session_id":"s","encoding":"ndjson","time_unit":"ns"}'
    yield '{"type":"DefineFunction","id":"f","name":"f"}'
    for k in range(n):
        yield odd.get(k) or '{"type":"Instant","source_id":"%s","source_seq":%d,"quality":"exact","ts_ns":%d,"name":"n"}' % ("ab"[k % 2], k, k // 3)


@pytest.mark.parametrize(
    ("odd", "reason", "line"),
    [
        ({}, None, None), ({900: '{"type":"Instant","source_id":"a","source_seq":898,"quality":"exact","ts_ns":300}'}, "out_of_order", 903), ({901: '{"type":"Instant","source_id":"b","source_seq":2000,"quality":"exact","ts_ns":1}'}, "out_of_order", 904),
        ({500: '{"type":"DefineFunction","id":"g","name":"g"}', 700: "{"}, "dictionary_after_observation", 503), ({5: "{", 600: '{"type":"DefineFunction","id":"g","name":"g"}'}, "truncated_json", 8),
    ],
)
def test_one_file_in_many_splits(spark, tmp_path, odd, reason, line):
    (tmp_path / "o.ndjson").write_text("\n".join(lines_of(1000, odd)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = canonical.records(spark, str(tmp_path / "o.ndjson")).orderBy("line").collect()
        assert spark.read.text(str(tmp_path / "o.ndjson")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["line"] for r in got] == [*range(1, (line or 1002) + 1)] and {r["session_id"] for r in got} == {"s"}
    assert [(r["bad"], r["line"]) for r in got if r["bad"]] == ([(reason, line)] if reason else [])


def test_canonical_metadata_reach_the_verdict(spark, tmp_path):
    row = '{"type":"Metadata","source_id":"a","source_seq":%d,"quality":"exact","ts_ns":%d,"key":"%s","value":%s}'
    said = [("health.flow-error", '"yes"'), ("overflow", '"7"'), ("overflow", "7"), ("elf_match", "false"), ("truncated", '{"a":1}'), ("note", "true")]
    (tmp_path / "o.ndjson").write_text("\n".join(['{"schema":"observations/1","session_id":"s","encoding":"ndjson"}', *(row % (k, k, *x) for k, x in enumerate(said))]))
    found = canonical.observations(canonical.records(spark, str(tmp_path / "o.ndjson")))
    assert found.count() == 6
    assert sorted(r["code"] for r in replay.facts(replay.replay(found)).collect()) == ["elf_mismatch", "flow_error", "trace_overflow"]


def test_sample_contracts(spark):
    from spanloom.operators import samples, stacks

    buckets = spark.createDataFrame([("a", 0, 4, 2), ("a", 4, 8, 1), ("b", 0, 4, 1), ("b", 2, 2, 1)], "session_id string, start bigint, end bigint, hits bigint")
    declared = spark.createDataFrame([("a", 3, "snoop", False, "unverified", None, None), ("b", 3, "stop_and_go", False, "verified", None, "target_image_comparison"), ("c", 0, "snoop", False, "mismatch", "ab", "digest_bound_deployment")], "session_id string, in_scope_hits bigint, method string, intrusive boolean, firmware_status string, elf_sha256 string, firmware_proof string")
    got = {(r["session_id"], r["violation"]) for r in samples.histogram_violations(buckets, declared).collect()}
    assert got == {("b", "overlapping_buckets"), ("b", "empty_bucket"), ("b", "hits_mismatch"), ("b", "method_not_intrusive"), ("b", "firmware_proof"), ("c", "no_buckets"), ("c", "firmware_proof")}
    walks = spark.createDataFrame([("a", 1, ["f", "g"], [0, 1], "terminal", 5), ("a", 2, ["f"], [1], "max_frames", 0), ("a", 4, [], [], "terminal", 1)], "session_id string, sample_index bigint, frames array<string>, depths array<int>, termination string, halt_ns bigint")
    captures = spark.createDataFrame([("a", 2, 3, 3, 3, 7), ("z", 2, 0, 0, 3, 0)], "session_id string, max_frames int, collected_samples int, attempted_samples int, max_samples int, total_halt_ns bigint")
    got = {(r["session_id"], r["sample_index"], r["violation"]) for r in stacks.sample_violations(walks, captures).collect()}
    assert got == {("a", 2, "depth_not_contiguous"), ("a", 2, "empty_halt"), ("a", 2, "ended_short_of_max_frames"), ("a", 4, "sample_index_not_contiguous"), ("a", 4, "empty_stack"), ("a", None, "halt_sum"), ("z", None, "no_samples")}
