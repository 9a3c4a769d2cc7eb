"""Registered queries of contracts that rows break, coverage, references and sampling reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import catalog, checks, compare, counters, coverage, reports, samples
from spanloom.plans import adapters as A
from spanloom.plans import registry
from spanloom.plans.fleets import ORACLE_SQL, QUERIES
from spanloom.plans.registry import query
from spanloom.sources import files

__all__ = ["ORACLE_SQL", "QUERIES"]


def _named(prefix: str, column: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


# contracts


@query("""
WITH p AS (SELECT p_partkey AS k, 'm-' || (p_partkey // 20 % 50) AS session_id, 'c-' || p_partkey AS counter_id, CASE WHEN p_partkey % 9 = 0 THEN 'count' ELSE 'bytes' END AS unit, p_partkey % 4 AS s,
  CASE WHEN p_partkey % 7 <> 0 THEN 'x' || (p_partkey // 5) END AS subject, CASE WHEN p_partkey % 4 = 1 THEN CASE WHEN p_size % 2 = 0 THEN 'task' ELSE 'isr' END END AS role, CASE WHEN p_partkey % 3 = 0 THEN 'isr' ELSE 'task' END AS context_kind FROM part),
n AS (SELECT *, count(*) OVER (PARTITION BY session_id, s, subject) AS many FROM p),
j AS (SELECT session_id, counter_id, CASE WHEN s < 3 AND subject IS NULL THEN 'semantic_without_subject' WHEN s = 3 AND subject IS NOT NULL THEN 'subject_without_semantic' WHEN s < 3 AND unit = 'count' THEN 'unit_mismatch'
  WHEN s IN (1, 2) AND k % 11 = 0 THEN 'subject_kind_mismatch' WHEN role <> context_kind THEN 'stack_role_mismatch' WHEN s < 3 AND many > 1 THEN 'duplicate_subject' END AS violation FROM n)
SELECT * FROM j WHERE violation IS NOT NULL""")
def counter_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts read as counter definitions, and the first rule that each breaks."""
    k = F.col("p_partkey")
    meant, kinds = F.lit(["heap.free_bytes", "stack.peak_used_bytes", "ram.peak_used_bytes", None]), F.lit(["allocator", "stack", "memory_region", None])
    rows = A.table(spark, sf_dir, "part").select(
        _named("m-", F.floor(k / 20) % 50).alias("session_id"), _named("c-", k).alias("counter_id"), F.when(k % 9 == 0, "count").otherwise("bytes").alias("unit"), F.get(meant, (k % 4).cast("int")).alias("semantic"),
        F.when(k % 11 == 0, "allocator").otherwise(F.get(kinds, (k % 4).cast("int"))).alias("subject_kind"), F.when(k % 7 != 0, _named("x", F.floor(k / 5))).alias("subject"),
        F.when(k % 4 == 1, F.when(F.col("p_size") % 2 == 0, "task").otherwise("isr")).alias("role"), F.when(k % 3 == 0, "isr").otherwise("task").alias("context_kind"),
    )
    return checks.counter_definition_violations(rows, counters.semantics(spark))


@query("""
WITH t AS (SELECT l_suppkey AS k, l_returnflag AS function_id, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, min(CAST(l_quantity AS BIGINT)) AS low, max(CAST(l_quantity AS BIGINT)) AS high FROM lineitem GROUP BY ALL),
d AS (SELECT *, CASE WHEN k % 11 = 0 THEN 0 ELSE n END AS a, CASE WHEN k % 13 = 0 THEN high + 1 WHEN k % 7 = 0 THEN q // n + 1 ELSE q // n END AS average, CASE WHEN k % 5 = 0 THEN q + 1 ELSE q // 2 END AS own FROM t),
j AS (SELECT 's-' || k AS session_id, function_id, CASE WHEN a <= 0 THEN 'no_activations' WHEN average < low OR average > high THEN 'average_out_of_range' WHEN average <> q // greatest(a, 1) THEN 'average_mismatch' WHEN own > q THEN 'self_exceeds_inclusive' END AS violation FROM d)
SELECT * FROM j WHERE violation IS NOT NULL""")
def hotspot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of suppliers' lines, some of them spoiled, and the first rule that each breaks."""
    k, q = F.col("l_suppkey"), F.col("l_quantity").cast("bigint")
    own = A.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("function_id")).agg(F.count("*").alias("n"), F.sum(q).alias("inclusive_ns"), F.min(q).alias("min_ns"), F.max(q).alias("max_ns"))
    average = F.expr("inclusive_ns div n")
    rows = own.select(
        _named("s-", k).alias("session_id"), "function_id", F.when(k % 11 == 0, 0).otherwise(F.col("n")).alias("activations"), "inclusive_ns", "min_ns", "max_ns",
        F.when(k % 13 == 0, F.col("max_ns") + 1).when(k % 7 == 0, average + 1).otherwise(average).alias("average_ns"), F.when(k % 5 == 0, F.col("inclusive_ns") + 1).otherwise(F.expr("inclusive_ns div 2")).alias("self_ns"),
    )
    return checks.hotspot_violations(rows)


@query("""
WITH b AS (SELECT l_suppkey AS k, l_partkey % 16 * 64 AS low, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, low) AS place FROM b),
l AS (SELECT k, place, low + CASE WHEN place = 6 THEN 1 ELSE 0 END AS bucket, n, low + CASE WHEN place = 3 THEN -4 ELSE place % 3 END AS a, n + CASE WHEN place IN (1, 4) THEN 1 ELSE 0 END AS hits FROM r),
m AS (SELECT l.*, a + place % 6 AS z, lag(hits) OVER (PARTITION BY k ORDER BY place) AS before FROM l),
j AS (SELECT 'v-' || k AS session_id, CAST(place AS INTEGER) AS place, CASE WHEN place > 10 THEN 'too_many_labels' WHEN place = 6 THEN 'unknown_bucket' WHEN hits > before THEN 'not_sorted' WHEN a < bucket OR z > bucket + 64 THEN 'outside_bucket' WHEN z <= a OR z - a > 4 THEN 'empty_or_wide' WHEN hits > n THEN 'more_hits_than_bucket' END AS violation FROM m)
SELECT * FROM j WHERE violation IS NOT NULL""")
def label_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the fullest buckets of suppliers' parts, some of them spoiled, and the first rule that each breaks."""
    buckets = A.table(spark, sf_dir, "lineitem").groupBy(_named("v-", "l_suppkey").alias("session_id"), (F.col("l_partkey") % 16 * 64).alias("start")).agg(F.count("*").alias("hits")).withColumn("end", F.col("start") + 64)
    ranked = samples.hottest(buckets, 16, "start")
    place, start = F.col("place"), F.col("start")
    low = start + F.when(place == 3, -4).otherwise(place % 3)
    labels = ranked.select("session_id", "place", (start + F.when(place == 6, 1).otherwise(0)).alias("bucket"), low.alias("low"), (low + place % 6).alias("high"), (F.col("hits") + F.when(place.isin(1, 4), 1).otherwise(0)).alias("hits"))
    return checks.label_violations(labels, buckets)


@query("""
WITH w AS (SELECT o_custkey AS k, max(CASE WHEN o_orderkey % 97 = 0 THEN 3 WHEN o_orderkey % 31 = 0 THEN 2 WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS worst FROM orders GROUP BY o_custkey),
j AS (SELECT 'h-' || c_custkey AS session_id, CASE WHEN worst >= 2 AND c_custkey % 3 <> 2 OR worst = 1 AND c_custkey % 3 = 0 THEN 'verdict_below_severity' WHEN c_custkey % 10 = 0 THEN 'support_without_reason' WHEN c_custkey % 10 = 7 THEN 'repeated_reason' END AS violation FROM customer LEFT JOIN w ON k = c_custkey)
SELECT * FROM j WHERE violation IS NOT NULL""")
def report_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of customers whose verdict does not cover their orders' severities, or whose reasons are missing or doubled."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    customers = A.table(spark, sf_dir, "customer")
    verdicts = customers.select(_named("h-", c).alias("session_id"), F.get(F.lit(["VALID", "DEGRADED", "INVALID"]), (c % 3).cast("int")).alias("verdict"))
    issues = A.table(spark, sf_dir, "orders").select(_named("h-", "o_custkey").alias("session_id"), F.when(o % 97 == 0, "fatal").when(o % 31 == 0, "error").when(o % 5 == 0, "warning").otherwise("info").alias("severity"))
    said = F.when(c % 10 == 0, F.array().cast("array<string>")).when(c % 10 == 7, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    support = customers.select(_named("h-", c).alias("session_id"), F.lit("self_time").alias("metric"), F.when(c % 5 == 0, "inferred").otherwise("exact").alias("support"), said.alias("reasons"))
    return checks.report_violations(verdicts, issues, support)


@query("""
WITH s AS (SELECT user_id AS u, event_type AS counter_id, count(*) AS n, min(event_id) AS a, max(event_id) AS z, arg_min(value, event_id) AS first, arg_max(value, event_id) AS latest, min(value) AS least, max(value) AS greatest FROM events GROUP BY ALL),
j AS (SELECT 'u-' || u AS session_id, counter_id, CASE WHEN u % 13 = 0 THEN 'no_values' WHEN u % 17 = 0 AND z > a THEN 'window' WHEN u % 9 = 0 AND latest < first + 1 THEN 'extremes' WHEN u % 9 = 0 AND (first + 1 > greatest OR first < first + 1) THEN 'extremes' WHEN u % 7 = 0 THEN 'delta' WHEN u % 11 = 0 AND counter_id <> 'click' THEN 'rate_of_no_monotonic' END AS violation FROM s)
SELECT * FROM j WHERE violation IS NOT NULL""")
def resource_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of users' events, some of them spoiled, and the first rule that each breaks."""
    u = F.col("user_id")
    own = A.table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("counter_id")).agg(F.count("*").alias("n"), F.min("event_id").alias("a"), F.max("event_id").alias("z"), F.min_by("value", "event_id").alias("first"), F.max_by("value", "event_id").alias("latest"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    rows = own.select(
        _named("u-", u).alias("session_id"), "counter_id", F.when(u % 13 == 0, 0).otherwise(F.col("n")).alias("n"), F.when(u % 17 == 0, F.col("z")).otherwise(F.col("a")).alias("first_ts_ns"), F.when(u % 17 == 0, F.col("a")).otherwise(F.col("z")).alias("last_ts_ns"), "first", "latest",
        F.when(u % 9 == 0, F.col("first") + 1).otherwise(F.col("least")).alias("least"), "greatest", (F.col("latest") - F.col("first") + F.when(u % 7 == 0, 1).otherwise(0)).alias("delta"),
        F.when((F.col("counter_id") == "click") | (u % 11 == 0), F.lit(1.0)).alias("rate_per_s"), F.when(F.col("counter_id") == "click", "monotonic").otherwise("gauge").alias("behaviour"),
    )
    return checks.resource_violations(rows)


# coverage and support

_MODES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "none"]


@query(f"""
WITH w AS (SELECT board, unnest({_MODES}) AS mode FROM (SELECT DISTINCT 'b-' || (s_suppkey % 70) AS board FROM supplier)),
c AS (SELECT 'b-' || (o_custkey % 60) AS board, o_orderpriority AS mode, count(*) AS captures, list(DISTINCT o_orderstatus) AS seen FROM orders GROUP BY ALL),
j AS (SELECT w.board, w.mode, coalesce(captures, 0) AS captures, [x FOR x IN ['F', 'O', 'P'] IF NOT coalesce(list_contains(seen, x), false)] AS missing FROM w LEFT JOIN c ON w.board = c.board AND w.mode = c.mode)
SELECT board, mode, captures, array_to_string(missing, ',') AS missing_states, captures >= 40 AND len(missing) = 0 AS covered FROM j""")
def capture_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as captures: how many each board has in each mode, and which initial states it lacks."""
    captures = A.table(spark, sf_dir, "orders").select(_named("b-", F.col("o_custkey") % 60).alias("board"), F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("initial_state"))
    boards = A.table(spark, sf_dir, "supplier").select(_named("b-", F.col("s_suppkey") % 70).alias("board"))
    return coverage.capture_coverage(captures, boards, _MODES, ["F", "O", "P"], 40).withColumn("missing_states", F.array_join("missing_states", ","))


_REQUIRED = {"allocator": ["heap.current_allocated_bytes", "heap.free_bytes", "heap.peak_allocated_bytes"], "stack": ["stack.capacity_bytes", "stack.peak_used_bytes"], "trace_buffer": ["trace_buffer.peak_used_bytes"]}
_COUNTERS = f"""
c AS (SELECT 'q-' || (l_orderkey // 3) AS session_id, ['allocator', 'stack', 'trace_buffer'][l_linenumber % 3 + 1] AS subject_kind, 'x' || (l_partkey % 2) AS subject,
  [{_REQUIRED["allocator"]}, {_REQUIRED["stack"] + ["stack.current_used_bytes"]}, {_REQUIRED["trace_buffer"] + ["trace_buffer.capacity_bytes", "trace_buffer.current_used_bytes"]}][l_linenumber % 3 + 1][CAST(l_quantity AS BIGINT) % 3 + 1] AS semantic, CASE l_returnflag WHEN 'A' THEN 'task' WHEN 'R' THEN 'isr' END AS role FROM lineitem)"""


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read as counters of three kinds of subjects."""
    kind = (F.col("l_linenumber") % 3).cast("int")
    by_kind = F.lit([_REQUIRED["allocator"], [*_REQUIRED["stack"], "stack.current_used_bytes"], [*_REQUIRED["trace_buffer"], "trace_buffer.capacity_bytes", "trace_buffer.current_used_bytes"]])
    semantic = F.get(F.get(by_kind, kind), (F.col("l_quantity").cast("bigint") % 3).cast("int"))
    return A.table(spark, sf_dir, "lineitem").select(_named("q-", F.floor(F.col("l_orderkey") / 3)).alias("session_id"), F.get(F.lit([*_REQUIRED]), kind).alias("subject_kind"), _named("x", F.col("l_partkey") % 2).alias("subject"), semantic.alias("semantic"), F.when(F.col("l_returnflag") == "A", "task").when(F.col("l_returnflag") == "R", "isr").alias("role"))


@query(f"""
WITH {_COUNTERS}, due AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in _REQUIRED.items())}) AS t(subject_kind, wanted)),
s AS (SELECT session_id, c.subject_kind, subject, [x FOR x IN any_value(wanted) IF NOT list_contains(list(semantic), x)] AS missing FROM c JOIN due ON c.subject_kind = due.subject_kind GROUP BY ALL)
SELECT session_id, subject_kind, subject, array_to_string(list_sort(missing), ',') AS missing FROM s WHERE len(missing) > 0""")
def semantic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the allocators, stacks and trace buffers of captures lack of what must be measured of them."""
    return coverage.missing_semantics(_counters(spark, sf_dir), _REQUIRED).withColumn("missing", F.array_join("missing", ","))


@query(f"""
WITH {_COUNTERS}, s AS (SELECT session_id, [x FOR x IN ['isr', 'task'] IF NOT coalesce(list_contains(list(role) FILTER (subject_kind = 'stack'), x), false)] AS missing FROM c GROUP BY session_id)
SELECT session_id, array_to_string(missing, ',') AS missing FROM s WHERE len(missing) > 0""")
def role_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stack roles no counter of a capture has."""
    rows = _counters(spark, sf_dir)
    return coverage.missing_roles(rows, rows, ["task", "isr"]).withColumn("missing", F.array_join("missing", ","))


@query("""
WITH q AS (SELECT user_id AS u, max(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN CASE WHEN user_id % 4 = 0 THEN 2 ELSE 0 END ELSE CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END END) AS worst FROM events GROUP BY user_id)
SELECT 'u-' || c_custkey AS session_id, CASE WHEN worst IS NULL THEN 'unavailable' ELSE ['exact', 'inferred', 'statistical', 'unavailable'][greatest(worst, c_custkey % 3) + 1] END AS support FROM customer LEFT JOIN q ON u = c_custkey""")
def counter_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counters support: as declared of each customer, lowered by the worst quality among that user's counters."""
    c, u = F.col("c_custkey"), F.col("user_id")
    declared = A.table(spark, sf_dir, "customer").select(_named("u-", c).alias("session_id"), F.lit("counters").alias("family"), F.get(F.lit(["exact", "inferred", "statistical"]), (c % 3).cast("int")).alias("support"))
    quality = F.when((F.col("event_type") == "view") & (u % 4 == 0), "statistical").when(~F.col("event_type").isin("click", "view") & (u % 2 == 0), "inferred").otherwise("exact")
    return reports.resource_support(declared, A.table(spark, sf_dir, "events").select(_named("u-", u).alias("session_id"), quality.alias("quality")))


# references


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) * 1000 AS t, lag(event_id) OVER own AS p, lag(epoch_us(ts) * 1000) OVER own AS pt FROM events WINDOW own AS (PARTITION BY user_id ORDER BY event_id)),
a AS (SELECT *, CASE WHEN event_id % 13 <> 0 THEN pt END AS a_ns, t - coalesce(pt, 0) + event_id % 3 * 40 AS expected_ns FROM e)
SELECT 'u-' || user_id AS session_id, 'e-' || event_id AS anchor, a_ns, t AS b_ns, t - a_ns AS measured_ns, expected_ns, coalesce(abs(t - a_ns - expected_ns) <= 50, false) AS ok FROM a""")
def anchored_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of each event to the same user's last one, against one that is expected; some anchors are lost."""
    rows = A.table(spark, sf_dir, "events").select(_named("u-", "user_id").alias("session_id"), F.lit("a").alias("source_id"), F.col("event_id").alias("source_seq"), (F.unix_micros(F.col("ts").cast("timestamp_ltz")) * 1000).alias("ts_ns"))
    before = rows.selectExpr("*", "lag(source_seq) OVER (PARTITION BY session_id ORDER BY source_seq) AS p", "lag(ts_ns) OVER (PARTITION BY session_id ORDER BY source_seq) AS pt")
    anchors = before.selectExpr("session_id", "concat('e-', source_seq) AS anchor", "source_id AS a_source", "if(source_seq % 13 = 0, -1, p) AS a_seq", "source_id AS b_source", "source_seq AS b_seq", "ts_ns - coalesce(pt, 0) + source_seq % 3 * 40 AS expected_ns")
    return coverage.clock_anchors(rows, anchors, 50)


_RAM_KINDS = ("data", "bss", "noinit", "dma", "rtos", "custom")


@query(f"""
WITH t AS (SELECT 'type-' || (p_partkey // 12 % 40) AS session_id, p_partkey % 2 AS side, {", ".join(f"coalesce(sum(p_size) FILTER (p_partkey // 2 % 6 = {i}), 0) AS {k}" for i, k in enumerate(_RAM_KINDS))}, sum(p_size) AS total FROM part GROUP BY ALL),
m AS (SELECT b.session_id, unnest({[*_RAM_KINDS, "total"]}) AS kind, CAST(unnest([{", ".join(f"b.{k}" for k in (*_RAM_KINDS, "total"))}]) AS DOUBLE) AS baseline, CAST(unnest([{", ".join(f"c.{k}" for k in (*_RAM_KINDS, "total"))}]) AS DOUBLE) AS candidate FROM t b JOIN t c ON b.session_id = c.session_id AND b.side = 0 AND c.side = 1)
SELECT *, candidate - baseline AS delta, CASE WHEN baseline <> 0 THEN (candidate - baseline) / baseline END AS relative,
  CASE WHEN abs(candidate - baseline) > 8 AND (baseline = 0 OR abs((candidate - baseline) / baseline) > 0.1) THEN CASE WHEN candidate > baseline THEN 'regressed' ELSE 'improved' END ELSE 'unchanged' END AS outcome FROM m""")
def ram_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static memory of parts of even key against those of odd key, by kind."""
    k = F.col("p_partkey")
    rows = A.table(spark, sf_dir, "part").select(_named("type-", F.floor(k / 12) % 40).alias("type"), (k % 2).alias("side"), F.get(F.lit([*_RAM_KINDS]), (F.floor(k / 2) % 6).cast("int")).alias("kind"), F.col("p_size").alias("size_bytes"))
    totals = files.static_totals(rows.withColumn("session_id", F.concat_ws("|", "type", "side"))).selectExpr("*", "split(session_id, '[|]') AS p").selectExpr("*", "p[0] AS type", "p[1] AS side").drop("session_id").withColumnRenamed("type", "session_id")
    return coverage.compare_static_ram(totals.where("side = '0'"), totals.where("side = '1'"), ["session_id"], 8.0, 0.1)


@query("""
WITH f AS (SELECT l_suppkey AS k, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS ns FROM lineitem GROUP BY l_suppkey),
r AS (SELECT k, n + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS n, ns * (1 + k % 4 * 0.004::DOUBLE) AS ns FROM f WHERE k % 17 <> 0),
c AS (SELECT 's-' || f.k AS session_id, unnest(['presence', 'n', 'ns']) AS "check", unnest([r.k IS NOT NULL, r.n = f.n, abs(f.ns - r.ns) <= greatest(1.0, abs(r.ns) * 0.005::DOUBLE)]) AS ok, unnest([NULL, abs(f.n - r.n)::DOUBLE, abs(f.ns - r.ns)::DOUBLE]) AS error, unnest([NULL, abs(f.n - r.n)::DOUBLE / r.n, abs(f.ns - r.ns) / r.ns]) AS relative_error FROM f LEFT JOIN r ON f.k = r.k)
SELECT session_id, "check", error, relative_error, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY session_id) AS place FROM c WHERE NOT coalesce(ok, false)) WHERE place <= 5""")
def reference_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five failures of each check of suppliers' totals against reference totals, some of which are off or missing."""
    found = A.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("ns"))
    k = F.col("l_suppkey")
    reference = found.where(k % 17 != 0).select(_named("s-", k).alias("session_id"), (F.col("n") + F.when(k % 5 == 0, 1).otherwise(0)).alias("n"), (F.col("ns") * (1 + k % 4 * F.lit(0.004))).alias("ns"))
    judged = compare.against_reference(found.select(_named("s-", k).alias("session_id"), "n", "ns"), reference, ["session_id"], ["n"], ["ns"])
    return compare.first_failures(judged, ["session_id"], 5).drop("ok")


@query("""
WITH f AS (SELECT l_suppkey AS k, 's-' || l_suppkey AS session_id, CASE l_returnflag WHEN 'A' THEN 'heap.free_bytes' WHEN 'R' THEN 'heap.allocation_count' ELSE 'heap.external_fragmentation_ratio' END AS semantic, CASE l_returnflag WHEN 'A' THEN 'bytes' WHEN 'R' THEN 'count' ELSE 'ratio' END AS unit, 'x' || l_linenumber AS subject, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS value FROM lineitem GROUP BY ALL),
r AS (SELECT *, value + k % 3 AS due, CASE WHEN k % 19 = 0 THEN 'other' ELSE unit END AS due_unit FROM f)
SELECT session_id, semantic, subject, unit AS "check", unit = due_unit AND abs(value - due) <= CASE unit WHEN 'bytes' THEN greatest(1.0, due * 0.001::DOUBLE) WHEN 'ratio' THEN greatest(0.5, due * 0.02::DOUBLE) ELSE 0 END AS ok, abs(value - due) AS error, CASE WHEN due <> 0 THEN abs(value - due) / due END AS relative_error FROM r""")
def resource_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources against reference values, each within its unit's tolerance; counts must be equal."""
    flag, k = F.col("l_returnflag"), F.col("l_suppkey")
    semantic = F.when(flag == "A", "heap.free_bytes").when(flag == "R", "heap.allocation_count").otherwise("heap.external_fragmentation_ratio")
    unit = F.when(flag == "A", "bytes").when(flag == "R", "count").otherwise("ratio")
    found = A.table(spark, sf_dir, "lineitem").groupBy(k, _named("s-", k).alias("session_id"), semantic.alias("semantic"), unit.alias("unit"), _named("x", "l_linenumber").alias("subject")).agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("value"))
    reference = found.withColumns({"value": F.col("value") + k % 3, "unit": F.when(k % 19 == 0, "other").otherwise(F.col("unit"))})
    tolerances = spark.createDataFrame([("bytes", 1.0, 0.001), ("ratio", 0.5, 0.02)], "unit string, absolute double, share double")
    return compare.resource_reference(found, reference, tolerances)


@query("""
WITH s AS (SELECT 's-' || l_suppkey AS session_id, 'L' || l_linestatus AS source_id, l_orderkey AS a, l_orderkey + l_linenumber AS z, l_partkey FROM lineitem),
chosen AS (SELECT DISTINCT session_id, source_id, a, z + CASE WHEN l_partkey % 6 = 0 THEN 10 ELSE 0 END AS z FROM s)
SELECT session_id, 'found' AS part, count(*) AS n FROM s SEMI JOIN chosen c ON s.session_id = c.session_id AND s.source_id = c.source_id AND s.a = c.a AND s.z = c.z GROUP BY session_id
UNION ALL SELECT session_id, 'missing', count(*) FROM chosen c ANTI JOIN s ON s.session_id = c.session_id AND s.source_id = c.source_id AND s.a = c.a AND s.z = c.z GROUP BY session_id""")
def selected_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many activations a list by source and numbers selects of each capture, and how many of the list are none."""
    spans = A.table(spark, sf_dir, "lineitem").selectExpr("concat('s-', l_suppkey) AS session_id", "concat('L', l_linestatus) AS source_id", "l_orderkey AS source_seq_start", "l_orderkey + l_linenumber AS source_seq_end", "l_partkey")
    chosen = spans.withColumn("source_seq_end", F.col("source_seq_end") + F.when(F.col("l_partkey") % 6 == 0, 10).otherwise(0)).drop("l_partkey").distinct()
    found, missing = compare.selected_activations(spans, chosen)
    return found.select("session_id", F.lit("found").alias("part")).unionByName(missing.select("session_id", F.lit("missing").alias("part"))).groupBy("session_id", "part").agg(F.count("*").alias("n"))


@query("""
WITH k AS (SELECT DISTINCT l_orderkey AS o, CASE WHEN l_linenumber < 7 THEN l_returnflag END AS f FROM lineitem), s AS (SELECT o, list_sort(list(coalesce(f, 'none'))) AS keys FROM k GROUP BY o)
SELECT 'o-' || o_orderkey AS baseline_id, 'o-' || (o_orderkey + 1) AS candidate_id, 'function_set_differs' AS reason FROM orders LEFT JOIN s b ON b.o = o_orderkey LEFT JOIN s c ON c.o = o_orderkey + 1 WHERE b.keys IS DISTINCT FROM c.keys""")
def changed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose set of return flags differs from the next one's; a null is a key."""
    pairs = A.table(spark, sf_dir, "orders").select(_named("o-", "o_orderkey").alias("baseline_id"), _named("o-", F.col("o_orderkey") + 1).alias("candidate_id"))
    rows = A.table(spark, sf_dir, "lineitem").select(_named("o-", "l_orderkey").alias("session_id"), F.when(F.col("l_linenumber") < 7, F.col("l_returnflag")).alias("function_id"))
    return compare.set_differences(pairs, rows, ["function_id"], "function_set_differs")


@query(f"""
WITH c AS ({ORACLE_SQL["comparison_rows"]}),
r AS (SELECT *, row_number() OVER (PARTITION BY baseline_year ORDER BY CASE outcome WHEN 'regressed' THEN 0 WHEN 'inconclusive' THEN 1 WHEN 'improved' THEN 2 WHEN 'unchanged' THEN 3 ELSE 4 END, abs(coalesce(relative, delta)) DESC NULLS LAST, function_id, metric) AS place FROM c)
SELECT baseline_year, function_id, metric, outcome, CAST(place AS INTEGER) AS place FROM r WHERE place <= 12""")
def telling_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve most telling changes from each year to the next."""
    return compare.ranked_rows(registry._years(spark, sf_dir), ["baseline_year"], ["function_id", "metric"], 12).select("baseline_year", "function_id", "metric", "outcome", "place")


@query("SELECT 'a-' || p_partkey AS artifact_id, (SELECT count(*) > 50 FROM part WHERE 'a-' || p_partkey > 'a-15') AS more FROM part WHERE 'a-' || p_partkey > 'a-15' ORDER BY 1 LIMIT 50")
def artifact_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of fifty artifacts after a given one, and whether others follow."""
    return catalog.page(A.table(spark, sf_dir, "part").select(_named("a-", "p_partkey").alias("artifact_id")), "a-15", 50)


@query(f"""
WITH {registry._HEAT}, who AS (SELECT session_id, CAST(split_part(session_id, '-', 2) AS INTEGER) AS u, sum(hits) AS n FROM filled GROUP BY ALL),
judged AS (SELECT session_id, CASE WHEN u = 3 THEN 'target_not_running' WHEN n < 100 THEN 'too_few_hits' WHEN u = 7 THEN 'runtime_not_retained' END AS reason, u % 3 < 2 AS proven FROM who),
a AS (SELECT f.session_id, low, f.hits, row_number() OVER (PARTITION BY f.session_id ORDER BY f.hits DESC, low) AS place FROM filled f JOIN judged j ON j.session_id = f.session_id AND reason IS NULL),
h AS (SELECT heat.* FROM heat JOIN judged j ON j.session_id = heat.session_id AND reason IS NULL AND proven),
p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY hits DESC, function_id ASC NULLS LAST) AS place, count(*) OVER (PARTITION BY session_id) AS many FROM h)
SELECT session_id, 'address' AS part, CAST(low AS VARCHAR) AS label, CAST(hits AS BIGINT) AS hits FROM a WHERE place <= 25 UNION ALL SELECT session_id, 'function', function_id, hits FROM h
UNION ALL SELECT session_id, 'profile', CASE WHEN many <= 20 OR place < 20 THEN coalesce(function_id, '[unattributed]') ELSE '[other sampled PCs]' END, CAST(sum(hits) AS BIGINT) FROM p GROUP BY ALL
UNION ALL SELECT session_id, 'address withheld', reason, NULL FROM judged WHERE reason IS NOT NULL UNION ALL SELECT session_id, 'function withheld', coalesce(reason, 'firmware_not_proven'), NULL FROM judged WHERE reason IS NOT NULL OR NOT proven""")
def sampling_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of sampled addresses and functions; captures that are not admitted, or whose firmware is not proven, lack their parts."""
    buckets = registry._buckets(spark, sf_dir)
    user = F.split_part("session_id", F.lit("-"), F.lit(2)).cast("int")
    histograms = buckets.groupBy("session_id").agg(F.sum("hits").alias("in_scope_hits")).select(
        "session_id", (user != 3).alias("target_running"), F.lit(50).alias("last_sample_rate_hz"), "in_scope_hits", F.lit(10**9).cast("bigint").alias("observed_duration_ns"), F.when(user == 7, 80.0).otherwise(95.0).alias("retained_runtime_percent"), F.lit(0).alias("snoop_failures"),
        F.get(F.lit(["verified", "deployment_asserted", "mismatch"]), user % 3).alias("firmware_status"),
    )
    found = samples.sampling_report(histograms, buckets, A.pc_ranges(spark, sf_dir))
    form = lambda df, part, label: df.select("session_id", F.lit(part).alias("part"), label.cast("string").alias("label"), F.col("hits").cast("bigint").alias("hits"))
    out = form(found["address"], "address", F.col("start")).unionByName(form(found["function"], "function", F.col("function_id"))).unionByName(form(found["profile"], "profile", F.col("label")))
    return out.unionByName(found["withheld"].select("session_id", F.concat("part", F.lit(" withheld")).alias("part"), F.col("reason").alias("label"), F.lit(None).cast("bigint").alias("hits")))
