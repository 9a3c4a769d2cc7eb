"""Contracts, reports, comparisons, catalogue and timelines on small data that SQL does not cover."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import scalar
from spanloom.operators import catalog, checks, compare, counters, coverage, reports, samples, timeline
from spanloom.sources import canonical, documents, files


def reasons(df, key):
    return {r[key]: r["violation"] for r in df.collect()}


def test_counter_definitions(spark):
    schema = "session_id string, counter_id string, unit string, semantic string, subject_kind string, subject string, role string, context_kind string"
    rows = [
        ("s", "good", "bytes", "heap.free_bytes", "allocator", "h", None, None), ("s", "unit", "count", "ram.peak_used_bytes", "memory_region", "r", None, None), ("s", "kind", "bytes", "stack.capacity_bytes", "allocator", "x", None, None),
        ("s", "alone", "bytes", "heap.peak_allocated_bytes", None, None, None, None), ("s", "role", "bytes", "stack.peak_used_bytes", "stack", "t", "task", "isr"), ("s", "two", "bytes", "heap.free_bytes", "allocator", "twice", None, None), ("s", "too", "bytes", "heap.free_bytes", "allocator", "twice", None, None),
    ]
    got = reasons(checks.counter_definition_violations(spark.createDataFrame(rows, schema), counters.semantics(spark)), "counter_id")
    assert got == {"unit": "unit_mismatch", "kind": "subject_kind_mismatch", "alone": "semantic_without_subject", "role": "stack_role_mismatch", "two": "duplicate_subject", "too": "duplicate_subject"}


def test_labels_and_reports(spark):
    labels = spark.createDataFrame([("s", 1, 0, 4, 8, 9), ("s", 2, 0, 8, 20, 3), ("s", 3, 64, 60, 62, 2), ("s", 4, 99, 99, 100, 1)], "session_id string, place int, bucket bigint, low bigint, high bigint, hits bigint")
    buckets = spark.createDataFrame([("s", 0, 64, 10), ("s", 64, 128, 5)], "session_id string, start bigint, end bigint, hits bigint")
    assert reasons(checks.label_violations(labels, buckets), "place") == {2: "empty_or_wide", 3: "outside_bucket", 4: "unknown_bucket"}
    verdicts = spark.createDataFrame([("a", "VALID"), ("b", "DEGRADED"), ("c", "INVALID"), ("d", "VALID")], "session_id string, verdict string")
    issues = spark.createDataFrame([("a", "warning"), ("b", "error"), ("c", "fatal")], "session_id string, severity string")
    support = spark.createDataFrame([("c", "self_time", "unavailable", []), ("d", "self_time", "inferred", ["x", "x"])], "session_id string, metric string, support string, reasons array<string>")
    assert reasons(checks.report_violations(verdicts, issues, support), "session_id") == {"a": "verdict_below_severity", "b": "verdict_below_severity", "c": "support_without_reason", "d": "repeated_reason"}


def test_resource_summaries(spark):
    schema = "session_id string, counter_id string, n bigint, first_ts_ns bigint, last_ts_ns bigint, first double, latest double, least double, greatest double, delta double, rate_per_s double, behaviour string"
    rows = [("s", "ok", 2, 0, 5, 1.0, 3.0, 1.0, 3.0, 2.0, 4.0, "monotonic"), ("s", "extremes", 2, 0, 5, 1.0, 9.0, 1.0, 3.0, None, None, None), ("s", "delta", 2, 0, 5, 1.0, 3.0, 1.0, 3.0, 1.0, None, None), ("s", "rate", 2, 0, 5, 1.0, 3.0, 1.0, 3.0, 2.0, 1.0, "gauge")]
    assert reasons(checks.resource_violations(spark.createDataFrame(rows, schema)), "counter_id") == {"extremes": "extremes", "delta": "delta", "rate": "rate_of_no_monotonic"}


def test_capabilities_and_resource_support(spark):
    receipts = spark.createDataFrame([("a", "counters", "exact", ["r"]), ("a", "custom", "exact", []), ("a", "context_switches", "unavailable", ["off"])], "session_id string, family string, support string, reasons array<string>")
    sessions = spark.createDataFrame([("a",), ("b",)], "session_id string")
    found = {(r["session_id"], r["family"]): (r["support"], r["reasons"]) for r in reports.capabilities(receipts, sessions).collect()}
    assert found["a", "counters"] == ("exact", ["r"]) and found["a", "samples"] == ("unavailable", ["capability_undeclared:samples"]) and found["b", "counters"] == ("unavailable", ["capture_receipt_missing:counters"]) and len(found) == 10
    seen = spark.createDataFrame([("a", "c", "inferred")], "session_id string, counter_id string, quality string")
    assert {r["session_id"]: r["support"] for r in reports.resource_support(reports.capabilities(receipts, sessions), seen).collect()} == {"a": "inferred", "b": "unavailable"}


OBSERVED = "session_id string, ord bigint, source_id string, source_seq bigint, quality string, type string, ts_ns bigint, core_id bigint, context_id string, function_id string, next_context_id string, interrupt_id string, activation_id string, duration_ns bigint, counter_id string, value double, behaviour string, whole boolean, span_id string, name string"


def observed(spark):
    def row(i, kind, ts, **x):
        names = [c.split()[0] for c in OBSERVED.split(", ")]
        return tuple({"session_id": "s", "ord": i, "source_id": "src", "source_seq": i, "quality": "exact", "type": kind, "ts_ns": ts, "core_id": 0, **x}.get(n) for n in names)

    rows = [
        row(1, "ContextSwitch", 0, next_context_id="t"), row(2, "FunctionEnter", 1, context_id="t", function_id="f"), row(3, "Counter", 2, counter_id="heap.allocation_count", value=5.0, behaviour="monotonic", whole=True), row(4, "InterruptEnter", 3, interrupt_id="i", activation_id="1"),
        row(5, "InterruptExit", 5, interrupt_id="i", activation_id="1"), row(6, "Counter", 6, counter_id="heap.allocation_count", value=9.0, behaviour="monotonic", whole=True), row(7, "Sample", 7, context_id="t", function_id="f"), row(8, "SpanBegin", 7, span_id="p", name="phase"),
        row(9, "SpanBegin", 8, span_id="p", name="again"), row(10, "SpanEnd", 9, span_id="p"), row(11, "SpanEnd", 9, span_id="p"), row(12, "FunctionExit", 10, context_id="t", function_id="f"), row(13, "TraceGap", 1500, core_id=None, duration_ns=25),
    ]
    return spark.createDataFrame(rows, OBSERVED)


def test_analysis_and_summary(spark, tmp_path):
    found = reports.analyze(observed(spark), str(tmp_path / "replayed"))
    assert [(r["function_id"], r["active_ns"], r["preempted_ns"]) for r in found.spans.collect()] == [("f", 7, 2)]
    assert {r["code"] for r in found.facts.collect()} == {"duplicate_span_begin", "unmatched_span_end", "trace_gap"}
    assert found.verdicts.first()["verdict"] == "INVALID" and found.hotspots.count() == 0
    assert reports.analyze(observed(spark), include_untrusted=True).hotspots.first()["quality"] == "inferred"
    assert found.counters.first()["delta"] == 4.0 and found.sampling.first()["share"] == 1.0
    assert found.counts.first().asDict() == {"session_id": "s", "observations": 13, "spans": 1, "incomplete_spans": 0, "facts": 3, "issues": 3}
    shown = reports.summary(found, top=1, most_issues=2)
    assert shown["issues"].count() == 2 and shown["counters"].first()["group"] == "heap" and shown["contexts"].count() == 2


def test_timeline_documents(spark, tmp_path):
    rows = observed(spark)
    found = reports.analyze(rows, include_untrusted=True)
    events = timeline.span_events(found.spans).unionByName(timeline.observation_events(rows)).unionByName(timeline.health_events(found.verdicts))
    timeline.write_timeline(timeline.timeline(events), str(tmp_path / "t"))
    [part] = list((tmp_path / "t" / "session_id=s").glob("*.txt"))
    shown = json.loads(part.read_text())["traceEvents"]
    assert [(e["ph"], e["name"]) for e in shown if e["ph"] != "M"] == [
        ("i", "Capture health: INVALID"), ("X", "f"), ("i", "Context switch"), ("C", "heap.allocation_count"), ("B", "i"), ("E", "i"), ("C", "heap.allocation_count"), ("i", "f"), ("B", "phase"), ("E", "phase"), ("X", "Trace gap"),
    ]
    gap = shown[-1]
    assert (gap["ts"], gap["dur"], gap["tid"]) == (1.5, 0.025, timeline.GAPS)
    first = {}
    for k, e in enumerate(shown):
        first.setdefault(e["tid"], (k, e["ph"]))
    assert all(ph == "M" for _, ph in first.values()) and len({e["tid"] for e in shown}) == 5
    assert timeline.observation_events(rows, raw_calls=True).where("cat = 'function_event'").count() == 2


def test_captures_compared(spark):
    base = {"health_session_id": None, "verdict": "VALID", "tool_name": "x", "tool_version": "1", "mode": "m", "adapter_id": "a", "adapter_version": "1", "architecture": "arm", "device": "d", "core_count": 1, "firmware": "f", "debugger": "g", "request_sha256": "q", "call_count": "exact", "active_time": "exact", "self_time": "exact", "provider": "p", "capabilities": "c", "config_artifact_id": "i", "config_sha256": "h"}
    schema = ", ".join(f"{c} {compare.FACTS[c]}" for c in ["session_id", *base])
    rows = [("a", *base.values()), ("b", *base.values()), ("c", *(base | {"device": "e", "firmware": "other", "verdict": "DEGRADED"}).values())]
    captures = spark.createDataFrame(rows, schema).withColumns({"covered_cores": F.lit([1, 0]).cast("array<bigint>"), "clocks": F.expr("array(struct('clk' AS id, CAST(5 AS BIGINT) AS frequency_hz))"), "policy_version": F.lit("1")})
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "none")], "baseline_id string, candidate_id string")
    hotspots = spark.createDataFrame([(s, f, n, t, t, t, t, t) for s, f, n, t in [("a", "f", 2, 100), ("b", "f", 2, 150), ("c", "f", 1, 5)]], "session_id string, function_id string, activations bigint, inclusive_ns bigint, self_ns bigint, min_ns bigint, max_ns bigint, average_ns bigint")
    metric_rows, verdicts = compare.compare_captures(pairs, captures, hotspots, compare.STRICT)
    got = {(r["baseline_id"], r["candidate_id"]): (r["verdict"], r["reasons"]) for r in verdicts.collect()}
    assert got["a", "b"] == ("regressed", [])
    assert got["a", "c"] == ("inconclusive", ["candidate_health_not_valid", "capture_target_mismatch", "capture_firmware_mismatch"])
    assert got["a", "none"][0] == "inconclusive" and "candidate_manifest_invalid" in got["a", "none"][1] and "function_set_differs" in got["a", "none"][1]
    assert {r["metric"]: r["outcome"] for r in metric_rows.collect()} == {"activations": "unchanged"} | dict.fromkeys(["inclusive_ns", "self_ns", "min_ns", "max_ns", "average_ns"], "regressed")
    ranked = compare.ranked_rows(metric_rows, ["baseline_id", "candidate_id"], ["metric"], 2)
    assert [r["metric"] for r in ranked.orderBy("place").collect()] == ["average_ns", "inclusive_ns"]


def test_fleet_has_one_verdict_over_all_families(spark):
    facts = "session_id string, verdict string, call_count string, active_time string, self_time string"
    captures = spark.createDataFrame([(s, "DEGRADED" if s == "bad" else "VALID", "exact", "exact", "exact") for s in ("a", "same", "slow", "heap", "other", "bad", "ram", "none", "void")], facts)
    hot = [(s, None, "f", 2, t, t, t, t, t) for s, t in [("a", 100), ("same", 102), ("slow", 150), ("heap", 100), ("bad", 100), ("ram", 100)]] + [("other", None, "g", 2, 5, 5, 5, 5, 5)]
    hotspots = spark.createDataFrame(hot, "session_id string, context_id string, function_id string, activations bigint, inclusive_ns bigint, self_ns bigint, min_ns bigint, max_ns bigint, average_ns bigint")
    sampled = spark.createDataFrame([(s, "f", 1, None, 1.0) for s in ("a", "same", "slow", "heap", "bad", "ram")], "session_id string, function_id string, address bigint, context_id string, share double")
    resources = spark.createDataFrame([(s, "1", "heap.free_bytes", "h", 50.0 if s == "heap" else 100.0) for s in ("a", "same", "heap")] + [(s, "2", "ram.current_used_bytes", "r", 1.0 if s == "a" else 9.0) for s in ("a", "same")], "session_id string, counter_id string, semantic string, subject string, value double")
    rules = spark.createDataFrame([("heap.free_bytes", None, 1.0, 0.1, False)], "semantic string, subject string, absolute double, share double, lower_is_better boolean")
    ram = spark.createDataFrame([(s, *[10] * 6, 40 if s == "ram" else 10) for s in ("a", "ram")], "session_id string, " + ", ".join(f"{k}_bytes bigint" for k in coverage.KINDS))
    pairs = spark.createDataFrame([("a", s) for s in ("same", "slow", "heap", "other", "bad", "ram", "ram")] + [("none", "void")], "baseline_id string, candidate_id string")
    rows, verdicts = compare.compare_fleet(pairs, captures, hotspots, compare.RELAXED, sampled, resources.where("session_id NOT IN ('slow')"), rules, ram)
    got = {r["candidate_id"]: (r["verdict"], r["reasons"]) for r in verdicts.collect()}
    assert len(got) == 7 and verdicts.count() == 7
    assert got["same"] == ("unchanged", [])  # a resource without a rule has no say
    assert got["heap"] == ("regressed", [])
    assert got["slow"] == ("inconclusive", [])  # its heap is missing
    assert got["other"] == ("inconclusive", ["function_set_differs", "sampling_set_differs"])
    assert got["bad"] == ("inconclusive", ["candidate_health_not_valid"])
    assert got["void"] == ("inconclusive", ["no_common_metrics"])
    assert [(r["metric"], r["outcome"]) for r in rows.where("family = 'static_ram' AND outcome <> 'unchanged'").collect()] == [(coverage.KINDS[6], "regressed")]
    assert rows.where("candidate_id = 'bad'").count() == 0 and tuple(rows.columns) == compare.FAMILY
    # functions alone: the slow one has regressed
    assert {r["candidate_id"]: r["verdict"] for r in compare.compare_fleet(pairs, captures, hotspots, compare.Policy())[1].collect()}["slow"] == "regressed"


def test_resource_reasons(spark):
    pairs = spark.createDataFrame([("a", "b")], "baseline_id string, candidate_id string")
    rows = [("a", "1", "heap.free_bytes", "h", 10.0), ("b", "1", "heap.free_bytes", "g", 10.0), ("a", "2", "ram.peak_used_bytes", "r", 10.0), ("b", "2", "ram.peak_used_bytes", "r", 20.0), ("a", "3", "ram.peak_used_bytes", "gone", 1.0)]
    resources = spark.createDataFrame(rows, "session_id string, counter_id string, semantic string, subject string, value double")
    rules = spark.createDataFrame([("ram.peak_used_bytes", None, 1.0, 0.1, True)], "semantic string, subject string, absolute double, share double, lower_is_better boolean")
    found, why = compare.compare_resources(pairs, resources, rules, compare.STRICT)
    assert sorted((r["subject"], r["outcome"]) for r in found.collect()) == [("gone", "inconclusive"), ("r", "regressed")]
    assert {r["reason"] for r in why.collect()} == {"resource_counter_identity_mismatch:1", "resource_subject_set_differs:ram.peak_used_bytes"}


def test_references(spark):
    keys = "session_id string, semantic string, subject string, unit string, value double"
    found, reference = spark.createDataFrame([("s", "a", "x", "bytes", 100.0), ("s", "b", "x", "count", 5.0)], keys), spark.createDataFrame([("s", "a", "x", "bytes", 104.0), ("s", "b", "x", "count", 6.0), ("s", "c", "x", "count", 0.0)], keys)
    tolerances = spark.createDataFrame([("bytes", 1.0, 0.05)], "unit string, absolute double, share double")
    judged = compare.resource_reference(found, reference, tolerances)
    assert {r["semantic"]: r["ok"] for r in judged.collect()} == {"a": True, "b": False, "c": False}
    assert [(r["semantic"], r["place"]) for r in compare.first_failures(judged, ["semantic"], 1).collect()] == [("b", 1)]
    rules = compare.with_rules(found, spark.createDataFrame([("a", "x", 1.0, 0.1)], "semantic string, subject string, absolute double, share double"), spark.createDataFrame([("a", 2.0, 0.2), ("b", 3.0, 0.3)], "semantic string, absolute double, share double"))
    assert {r["semantic"]: r["rule"]["absolute"] for r in rules.collect()} == {"a": 1.0, "b": 3.0}
    spans = spark.createDataFrame([("s", "p", 1, 2, "f"), ("s", "p", 3, 4, "g")], "session_id string, source_id string, source_seq_start bigint, source_seq_end bigint, function_id string")
    chosen = spark.createDataFrame([("s", "p", 3, 4), ("s", "p", 9, 9)], "session_id string, source_id string, source_seq_start bigint, source_seq_end bigint")
    some, none = compare.selected_activations(spans, chosen)
    assert [r["function_id"] for r in some.collect()] == ["g"] and none.count() == 1


def test_catalogue(spark, tmp_path):
    (tmp_path / "x").write_text("abc")
    found = catalog.digests(spark.read.format("binaryFile").load(str(tmp_path / "x")))
    row = found.first()
    artifacts = spark.createDataFrame([("a", row["path"], 3, row["sha256"].upper()), ("b", row["path"], 4, row["sha256"]), ("c", "none", 1, "0"), ("d", row["path"], 3, "0")], "artifact_id string, path string, size bigint, sha256 string")
    assert reasons(catalog.content_violations(artifacts, found), "artifact_id") == {"b": "size_mismatch", "c": "missing", "d": "digest_mismatch"}
    made = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["b", "e"]), ("d", ["c"]), ("e", ["d"]), ("f", ["zz", "b"])], "artifact_id string, inputs array<string>")
    assert {(r["artifact_id"], r["violation"]) for r in catalog.reference_violations(made).collect()} == {("c", "cycle"), ("d", "cycle"), ("e", "cycle"), ("f", "unknown_input")}
    first = catalog.page(made, None, 4).collect()
    assert [r["artifact_id"] for r in first] == ["a", "b", "c", "d"] and first[0]["more"]
    assert [(r["artifact_id"], r["more"]) for r in catalog.page(made, "d", 4).collect()] == [("e", False), ("f", False)]


def test_canonical_files(spark, tmp_path):
    rows = observed(spark).drop("behaviour", "whole", "bad")
    entries = spark.createDataFrame([("s", '{"type":"DefineFunction","id":"f","name":"main","line":3}')], "session_id string, definition string")
    canonical.write(rows, entries, str(tmp_path / "obs"), "observations/1")
    found = canonical.records(spark, str(tmp_path / "obs"))
    assert found.where("bad IS NOT NULL").count() == 0 and canonical.observations(found).count() == 13
    assert canonical.observations(found).where("type = 'TraceGap'").first()["duration_ns"] == 25
    assert [(r["kind"], r["id"], r["name"], r["line"]) for r in canonical.dictionary(found).collect()] == [("function", "f", "main", 3)]
    with pytest.raises(Exception, match="out of order in s"):
        canonical.write(rows.withColumn("source_seq", F.lit(1).cast("bigint")), entries, str(tmp_path / "bad"), "observations/1")


HEAD = '{"schema":"x","session_id":"s","encoding":"ndjson"}'
CALL = '{"type":"FunctionEnter","source_id":"a","source_seq":%d,"quality":"exact","ts_ns":%d,"core_id":0,"context_id":"t","function_id":"f"}'


@pytest.mark.parametrize(
    ("text", "reason", "code", "kept"),
    [
        ([HEAD, CALL % (1, 1), '{"type":"DefineContext","id":"t","kind":"task","name":"t"}', CALL % (2, 2)], "dictionary_after_observation", "malformed_input", 1),
        ([HEAD, CALL % (1, 1), CALL.replace('"core_id":0', '"core_id":0,"core_id":1') % (2, 2)], "malformed_json", "malformed_input", 1),
        ([HEAD, CALL % (1, 1), (CALL % (2, 2))[:40]], "truncated_json", "truncated_input", 1),
        ([HEAD, CALL % (2, 1), CALL % (2, 2)], "out_of_order", "out_of_order_sequence", 1),
        ([HEAD, CALL.replace('"core_id":0', '"core":0') % (1, 1)], "unknown_member", "malformed_input", 0),
        ([HEAD, '{"type":"Odd"}'], "unknown_type", "malformed_input", 0),
        (['{"session_id":"s","encoding":"cbor","schema":"x"}', CALL % (1, 1)], "bad_header", "malformed_input", 0),
    ],
)
def test_first_bad_line(spark, tmp_path, text, reason, code, kept):
    (tmp_path / "o.ndjson").write_text("\n".join(text) + "\n")
    found = canonical.records(spark, str(tmp_path / "o.ndjson")).cache()
    assert [(r["code"], r["reason"]) for r in canonical.faults(found).collect()] == [(code, reason)]
    assert canonical.observations(found).count() == kept


def test_documents(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"session_id":"s","target_running":true,\n"in_scope_hits":5,"buckets":[{"start":0,"end":4,"hits":2},{"start":4,"end":8,"hits":3}]}')
    about, buckets = documents.histograms(spark, str(tmp_path / "h.json"))
    assert about.first()["in_scope_hits"] == 5 and [r["hits"] for r in buckets.orderBy("start").collect()] == [2, 3]
    (tmp_path / "k.json").write_text('{"session_id":"s","attempted":3,"collected":2,"samples":[{"index":1,"termination":"terminal","halt_ns":5,"frames":["a","b"]},{"index":2,"termination":"truncated","halt_ns":6,"frames":["a"]}]}')
    about, rows = documents.stack_samples(spark, str(tmp_path / "k.json"))
    assert documents.stack_accounting(about, rows).first().asDict() == {"session_id": "s", "attempted": 3, "collected": 2, "included": 2, "halt_ns": 11, "truncated": 1, "balanced": True}
    (tmp_path / "r.json").write_text('{"session_id":"s","capabilities":{"samples":{"support":"statistical","reasons":["x"]}}}')
    assert [tuple(r) for r in documents.receipts(spark, str(tmp_path / "r.json")).collect()] == [("s", "samples", "statistical", ["x"])]
    (tmp_path / "m.json").write_text('{"session_id":"s","tool":{"name":"n","version":"1"},"capture":{"mode":"m","target":{"device":"d"}},"artifacts":[{"artifact_id":"a","inputs":[]}]}')
    facts, made = documents.manifests(spark, str(tmp_path / "m.json"))
    assert (facts.first()["tool_name"], facts.first()["device"], made.first()["artifact_id"]) == ("n", "d", "a")
    (tmp_path / "z.json").write_text("{nonsense")
    with pytest.raises(Exception):  # noqa: B017  the reader's own error
        documents.receipts(spark, str(tmp_path / "z.json")).collect()


def test_span_files(spark, tmp_path):
    spans = reports.analyze(observed(spark)).spans
    documents.write_spans(spans, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    documents.write_spans_ndjson(spans, str(tmp_path / "n"), "in-1")
    schema = "session_id string, ord bigint, function_id string, active_ns bigint"
    assert [tuple(r) for r in documents.read_spans_ndjson(spark, str(tmp_path / "n"), schema, "in-1").collect()] == [("s", 2, "f", 7, None)]
    assert documents.read_spans_ndjson(spark, str(tmp_path / "n"), schema, "in-2").first()["violation"] == "other_input"


def test_scalars(spark):
    df = spark.createDataFrame([("aé日x", '{"a":{"b":1,"b":2}}'), ("abc", '{"a":[1]}'), ("日本語", "{")], "t string, j string")
    got = df.select(*[scalar.within_bytes(F.col("t"), n).alias(str(n)) for n in (1, 2, 3, 4, 5, 6, 9)], scalar.strict_json(F.col("j")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [False, True, False]
    for r, text in zip(got, ["aé日x", "abc", "日本語"], strict=True):
        for n in (1, 2, 3, 4, 5, 6, 9):
            assert r[str(n)] == text.encode()[:n].decode(errors="ignore")
    ids = spark.createDataFrame([("heap.free_bytes",), ("Heap.x",), ("heap",), ("a.b_2.c",)], "s string")
    assert [r[0] for r in ids.select(scalar.semantic_ok(F.col("s"))).collect()] == [True, False, False, True]
    gaps = spark.createDataFrame([("FIFO is full",), ("flow Error",), ("stream truncated",), ("ELF mismatch",), ("out of order",), ("quiet",)], "r string")
    assert [r[0] for r in gaps.select(scalar.severe_gap(F.col("r"))).collect()] == ["trace_overflow", "flow_error", "truncated_input", "elf_mismatch", "out_of_order_timestamp", None]


def test_sections_and_sampling_lines(spark, tmp_path):
    sections = spark.createDataFrame([("s", ".data"), ("s", ".data"), ("s", "a b"), ("s", ".bss")], "session_id string, name string")
    assert {(r["name"], r["violation"]) for r in files.section_violations(sections).collect()} == {(".data", "duplicate_section"), ("a b", "bad_name")}
    (tmp_path / "s.txt").write_text("1 P:0x10 exec 2us\nnonsense\n\n")
    assert [(r["ord"], r["bad"]) for r in files.read_sampling_text(spark, str(tmp_path / "s.txt")).collect()] == [(1, None), (None, "malformed_line")]
    usage = spark.createDataFrame([("s", "static", 8), ("s", "dynamic", 99), ("s", "static", 24)], "session_id string, qualifier string, bytes bigint")
    assert tuple(files.stack_totals(usage).first()) == ("s", 3, 24)


def test_hotspot_totals(spark):
    schema = "session_id string, function_id string, activations bigint, inclusive_ns bigint, self_ns bigint, min_ns bigint, max_ns bigint, average_ns bigint"
    rows = [("s", "ok", 3, 10, 10, 2, 5, 3), ("s", "none", 0, 0, 0, 0, 0, 0), ("s", "low", 2, 10, 4, 4, 6, 3), ("s", "off", 2, 10, 4, 4, 6, 6), ("s", "own", 1, 5, 6, 5, 5, 5)]
    assert reasons(checks.hotspot_violations(spark.createDataFrame(rows, schema)), "function_id") == {"none": "no_activations", "low": "average_out_of_range", "off": "average_mismatch", "own": "self_exceeds_inclusive"}


def test_required_semantics_and_roles(spark):
    rows = [("a", "allocator", "h", "x", None), ("a", "allocator", "h", "y", None), ("a", "stack", "t", "z", "task"), ("a", "stack", "i", "z", "isr"), ("b", "allocator", "h", "y", None), ("b", "other", "o", "q", "task"), ("c", "stack", "t", "w", "task"), ("c", "stack", "u", None, None)]
    counted = spark.createDataFrame(rows, "session_id string, subject_kind string, subject string, semantic string, role string")
    lacking = {(r["session_id"], r["subject"]): r["missing"] for r in coverage.missing_semantics(counted, {"allocator": ["x", "y"], "stack": ["z"]}).collect()}
    assert lacking == {("b", "h"): ["x"], ("c", "t"): ["z"], ("c", "u"): ["z"]}
    sessions = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "session_id string")
    assert {r["session_id"]: r["missing"] for r in coverage.missing_roles(counted, sessions, ["task", "isr"]).collect()} == {"b": ["isr", "task"], "c": ["isr"], "d": ["isr", "task"]}
    assert coverage.missing_roles(counted.where("false"), sessions.where("false"), ["task"]).count() == 0


def test_sampling_report(spark):
    """Captures that are not admitted lose all parts, those without proven firmware what functions tell; nulls prove nothing."""
    schema = "session_id string, target_running boolean, last_sample_rate_hz int, in_scope_hits bigint, observed_duration_ns bigint, retained_runtime_percent double, snoop_failures int, firmware_status string"
    histograms = spark.createDataFrame([("a", True, 9, 150, 10**9, 99.0, 0, "verified"), ("b", True, 9, 150, 10**9, 99.0, 0, None), ("c", True, 9, 12, 10**9, 99.0, 0, "verified"), ("d", True, 9, 150, 10**9, 99.0, 0, "mismatch")], schema)
    buckets = spark.createDataFrame([(s, x, x + 16, 50) for s in "abcde" for x in (0, 16, 32)], "session_id string, start bigint, end bigint, hits bigint")
    ranges = spark.createDataFrame([(s, "f", 0, 32) for s in "abcde"], "session_id string, function_id string, start bigint, end bigint")
    found = samples.sampling_report(histograms, buckets, ranges, displayed=2)
    assert {(r["session_id"], r["start"]) for r in found["address"].collect()} == {(s, x) for s in "abd" for x in (0, 16)}
    assert {(r["session_id"], r["function_id"], r["hits"]) for r in found["function"].collect()} == {("a", "f", 100), ("a", None, 50)}
    assert {(r["label"], r["hits"]) for r in found["profile"].collect()} == {("f", 100), ("[unattributed]", 50)}
    assert {tuple(r) for r in found["withheld"].collect()} == {("b", "function", "firmware_not_proven"), ("c", "address", "too_few_hits"), ("c", "function", "too_few_hits"), ("d", "function", "firmware_not_proven")}
