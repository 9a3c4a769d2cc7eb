"""Registered queries of evidence: named faults, several cores, retained facts, provenance, track numbers and canonical files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.tables import kept, shared_path
from spanloom.operators import catalog, health, replay, samples, stacks, timeline
from spanloom.plans import adapters as A
from spanloom.plans.audit import ORACLE_SQL, QUERIES
from spanloom.plans.registry import query
from spanloom.sources import canonical, wire

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("""
WITH r AS (SELECT 'cust-' || o_custkey AS session_id, o_orderkey AS k FROM orders),
f AS (SELECT session_id, 'warning' AS severity FROM r WHERE k % 4 = 0 UNION ALL SELECT session_id, 'fatal' FROM r WHERE k % 4 = 0 AND k // 4 % 6 <> 2 UNION ALL SELECT session_id, 'fatal' FROM r WHERE k % 4 = 1 AND k // 4 % 5 IN (0, 1, 3))
SELECT s.session_id, CASE WHEN bool_or(severity = 'fatal') THEN 'INVALID' WHEN count(severity) > 0 THEN 'DEGRADED' ELSE 'VALID' END AS verdict, count(severity) AS issues
FROM (SELECT DISTINCT session_id FROM r) s LEFT JOIN f ON s.session_id = f.session_id GROUP BY s.session_id""")
def told_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of captures whose gaps give a reason and whose metadata tell of faults, from their replay."""
    reasons = F.lit(["TRACE FIFO full", "buffer is full now", "paused", "flow error", "ELF mismatch", "Truncated"])
    keys, values = F.lit(["health.trace-overflow", "elf match", "overflow", "Flow_Error", "note"]), F.lit(["true", "false", "0", '"yes"', "true"])
    k = F.col("o_orderkey")
    nth = F.floor(k / 4)
    rows = A.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("session_id"), k.alias("ord"), k.alias("ts_ns"), F.lit("probe").alias("source_id"), F.when(k % 4 == 0, "TraceGap").when(k % 4 == 1, "Metadata").otherwise("Instant").alias("type"),
        F.when(k % 4 == 0, F.lit(0)).cast("bigint").alias("duration_ns"), F.get(reasons, (nth % 6).cast("int")).alias("reason"), F.get(keys, (nth % 5).cast("int")).alias("key"), F.get(values, (nth % 5).cast("int")).alias("value"),
    )
    return health.verdicts(rows, health.issues(health.capped(replay.facts(replay.replay(rows)))))


_CORES = """
r AS (SELECT 'm-' || (o_custkey % 50) AS session_id, o_orderkey AS ord, o_orderkey * 10 AS ts, o_orderkey // 3 % 2 AS core, 't' || (o_custkey // 50 % 3) AS task FROM orders),
e AS (SELECT * FROM r UNION ALL SELECT session_id, max(ord) OVER (PARTITION BY session_id) + 1, max(ts) OVER (PARTITION BY session_id), core, NULL FROM (SELECT session_id, core, max(ord) AS ord, max(ts) AS ts FROM r GROUP BY session_id, core)),
c AS (SELECT *, task IS NOT NULL AND task IS DISTINCT FROM lag(task) OVER own AS new, lag(ts) OVER own AS clock, lag(task) OVER own AS mine FROM e WINDOW own AS (PARTITION BY session_id, core ORDER BY ord)),
s AS (SELECT *, last_value(CASE WHEN core = 0 THEN task END IGNORE NULLS) OVER past AS task0, last_value(CASE WHEN core = 1 THEN task END IGNORE NULLS) OVER past AS task1, last_value(CASE WHEN core = 0 AND new THEN ts END IGNORE NULLS) OVER past AS since0, last_value(CASE WHEN core = 1 AND new THEN ts END IGNORE NULLS) OVER past AS since1
  FROM c WINDOW past AS (PARTITION BY session_id ORDER BY ord, core ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
credits AS (SELECT *, CASE WHEN task0 = task1 AND greatest(clock, since0, since1) < ts THEN greatest(clock, since0, since1) END AS begins FROM s WHERE ts > clock)"""


def _cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches of two cores; an order schedules its customer's task."""
    return replay.replay(A.table(spark, sf_dir, "orders").selectExpr("concat('m-', o_custkey % 50) AS session_id", "o_orderkey AS ord", "o_orderkey * 10 AS ts_ns", "'probe' AS source_id", "'ContextSwitch' AS type", "o_orderkey div 3 % 2 AS core_id", "concat('t', o_custkey div 50 % 3) AS next_context_id"))


@query(f"WITH {_CORES} SELECT session_id, mine AS context_id, 'task' AS kind, CAST(sum(CASE WHEN core = 1 AND begins IS NOT NULL THEN begins ELSE ts END - clock) AS BIGINT) AS active_ns FROM credits GROUP BY session_id, mine HAVING sum(CASE WHEN core = 1 AND begins IS NOT NULL THEN begins ELSE ts END - clock) > 0")
def multicore_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPU time of tasks on two cores; one that both have at once is credited on the lower only."""
    return replay.contexts(_cores(spark, sf_dir))


@query(f"""
WITH {_CORES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, mine ORDER BY ord, core) AS place FROM credits WHERE begins IS NOT NULL)
SELECT session_id, ord, mine AS context_id, core AS core_id, begins AS start_ns, ts AS end_ns FROM ranked WHERE place = 1""")
def concurrent_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a task was first found on two cores at once."""
    return replay.facts(_cores(spark, sf_dir)).where("code = 'concurrent_context'").select("session_id", "ord", "context_id", "core_id", "start_ns", "end_ns")


@query("""
WITH r AS (SELECT 'u-' || user_id AS session_id, event_id AS ord, event_id % 3 AS k, event_id % 4 AS core_id, CASE event_type WHEN 'click' THEN 'B' ELSE 'E' END AS type FROM events WHERE event_type IN ('click', 'view')),
s AS (SELECT *, lag(type) OVER (PARTITION BY session_id, k ORDER BY ord) AS b FROM r),
first AS (SELECT * FROM s WHERE type = 'B' AND b IS DISTINCT FROM 'B'), ends AS (SELECT * FROM s WHERE type = 'E' AND b = 'B'),
last AS (SELECT session_id, max(ord) AS ord FROM r GROUP BY session_id),
met AS (SELECT f.session_id, f.ord, f.core_id, min(e.ord) AS until FROM first f LEFT JOIN ends e ON e.session_id = f.session_id AND e.k = f.k AND e.ord > f.ord GROUP BY ALL)
SELECT m.session_id, m.ord, m.core_id, 'async' AS form, m.ord AS start_ns, coalesce(until, l.ord) AS end_ns, until IS NULL AS incomplete FROM met m JOIN last l ON m.session_id = l.session_id""")
def async_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that begin on one core and end on another."""
    rows = A.table(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    rows = rows.selectExpr("concat('u-', user_id) AS session_id", "event_id AS ord", "event_id AS ts_ns", "'a' AS source_id", "event_id % 4 AS core_id", "CAST(event_id % 3 AS STRING) AS correlation_id", "if(event_type = 'click', 'AsyncBegin', 'AsyncEnd') AS type")
    return replay.brackets(replay.replay(rows)).select("session_id", "ord", "core_id", "form", "start_ns", "end_ns", "incomplete")


@query("""
WITH f AS (SELECT 'u-' || user_id AS session_id, event_id AS ord, 'trace_gap' AS code, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, count(*) OVER (PARTITION BY user_id) AS many FROM events WHERE event_type = 'click')
SELECT session_id, ord, CASE WHEN many > 12 AND place = 12 THEN 'diagnostics_truncated' ELSE code END AS code, CASE WHEN many > 12 AND place = 12 THEN many - 11 END AS dropped FROM f WHERE place <= 12""")
def retained_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eleven facts of each session, and how many more there were where it has over twelve."""
    return health.capped(A.table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr("concat('u-', user_id) AS session_id", "event_id AS ord", "'trace_gap' AS code"), 12)


_INPUTS = """CASE WHEN k % 10 = 0 AND g % 2 = 1 THEN [g * 10 + 1, g * 10 - 5] WHEN k % 10 < 3 THEN [g * 10 + (k % 10 + 1) % 3] WHEN k % 10 < 6 THEN [k - 1] WHEN k % 10 = 6 AND g % 4 = 0 THEN [k] WHEN k % 10 = 8 THEN [k - 1] WHEN k % 10 = 9 THEN [-k] ELSE [] END"""


@query(f"""
WITH RECURSIVE p AS (SELECT p_partkey AS k, p_partkey // 10 AS g FROM part),
e AS (SELECT DISTINCT k AS b, unnest({_INPUTS}) AS a FROM p), known AS (SELECT * FROM e WHERE a IN (SELECT k FROM p)),
reach AS (SELECT a, b FROM known UNION SELECT r.a, n.b FROM reach r JOIN known n ON r.b = n.a),
rings AS (SELECT x.a AS k, max('a-' || x.b) AS cycle FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT 'a-' || k AS artifact_id, 'cycle' AS violation, cycle FROM rings UNION ALL SELECT DISTINCT 'a-' || b, 'unknown_input', NULL FROM e WHERE a NOT IN (SELECT k FROM p)""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts made of parts: unknown inputs and cycles; some groups of ten feed the next."""
    made = A.table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_partkey div 10 AS g")
    r, k, g = F.col("k") % 10, F.col("k"), F.col("g")
    inputs = F.when((r == 0) & (g % 2 == 1), F.array(g * 10 + 1, g * 10 - 5)).when(r < 3, F.array(g * 10 + (r + 1) % 3)).when(r < 6, F.array(k - 1)).when((r == 6) & (g % 4 == 0), F.array(k)).when(r == 8, F.array(k - 1)).when(r == 9, F.array(-k)).otherwise(F.array().cast("array<bigint>"))
    name = lambda x: F.concat(F.lit("a-"), x.cast("string"))
    return catalog.reference_violations(made.select(name(k).alias("artifact_id"), F.transform(inputs, name).alias("inputs")))


@query("""
WITH RECURSIVE used AS (SELECT 'n-' || (o_custkey % 40) AS session_id, 'ctx-' || (o_orderkey % 37) AS label, min(o_orderkey) AS first FROM orders GROUP BY ALL),
hashed AS (SELECT *, list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(list_concat(string_split('context', ''), [NULL], string_split(label, '')), lambda c: coalesce(unicode(c), 0)::UBIGINT)), lambda h, b: ((xor(h, b)::UHUGEINT * 1099511628211) % 18446744073709551616::UHUGEINT)::UBIGINT) AS h FROM used),
owners AS (SELECT session_id, label, h % 2147482623 % 64 AS own, row_number() OVER (PARTITION BY session_id ORDER BY first) AS place FROM hashed),
placed AS (SELECT DISTINCT session_id, ''::VARCHAR AS label, 0::BIGINT AS place, []::BIGINT[] AS taken FROM owners
  UNION ALL SELECT o.session_id, o.label, o.place, list_append(taken, list_filter(list_transform(range(64), lambda i: 1024 + (o.own::BIGINT + i) % 64), lambda x: NOT list_contains(taken, x))[1]) FROM placed p JOIN owners o ON p.session_id = o.session_id AND o.place = p.place + 1)
SELECT session_id, label, CAST(taken[place] AS INTEGER) AS track FROM placed WHERE place > 0""")
def numbered_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track numbers of 37 contexts a capture in 64 numbers, so that most meet another's."""
    rows = A.table(spark, sf_dir, "orders").selectExpr("concat('n-', o_custkey % 40) AS session_id", "o_orderkey AS ord", "o_orderkey AS ts_ns", "'probe' AS source_id", "o_orderkey AS source_seq", "'exact' AS quality", "'Instant' AS type", "0L AS core_id", "concat('ctx-', o_orderkey % 37) AS context_id", "'x' AS name", "CAST(NULL AS STRING) AS interrupt_id", "CAST(NULL AS STRING) AS next_context_id", "CAST(NULL AS BIGINT) AS duration_ns")
    return timeline.tracks(timeline.observation_events(rows), 64).select("session_id", F.col("owner.label").alias("label"), "track")


@query("""
WITH r AS (SELECT 'c-' || (o_custkey % 8) AS session_id, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) AS nth FROM orders), n AS (SELECT session_id, count(*) AS many FROM r GROUP BY session_id),
f(session_id, place, reason, code) AS (VALUES ('c-1', 20, 'malformed_json', 'malformed_input'), ('c-2', 15, 'unknown_member', 'malformed_input'), ('c-3', 10, 'out_of_order', 'out_of_order_sequence'), ('c-4', 12, 'truncated_json', 'truncated_input'), ('c-5', 8, 'dictionary_after_observation', 'malformed_input'))
SELECT n.session_id, CASE WHEN place <= many THEN place - 1 ELSE many END AS observations, 2 AS entries, CASE WHEN place <= many THEN reason END AS reason, CASE WHEN place <= many THEN code END AS code, CASE WHEN place <= many THEN place + 3 END AS line FROM n LEFT JOIN f ON n.session_id = f.session_id""")
def canonical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read of canonical files, written first, of which five end early: observations, entries, and why."""
    nth = F.col("nth")
    rows = A.table(spark, sf_dir, "orders").selectExpr("o_custkey % 8 AS s", "o_orderkey AS k", "row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) AS nth")
    hit = lambda s, n: (F.col("s") == s) & (nth == n)
    gap = F.format_string('{"type":"TraceGap","source_id":"a","source_seq":%d,"quality":"exact","ts_ns":%d,"duration_ns":1,"reason":"r"%s', F.col("k"), F.when(hit(3, 10), 0).otherwise(F.col("k") * 10), F.when(hit(1, 20), ',"reason":"s"').when(hit(2, 15), ',"colour":"s"').otherwise(""))
    line = F.when(hit(5, 8), '{"type":"DefineFunction","id":"late","name":"late"}').otherwise(F.concat(gap, F.when(hit(4, 12), "").otherwise("}")))
    body = rows.select("s", (nth + 3).alias("line"), line.alias("value"))
    top = F.array(
        F.struct(F.lit(1).cast("bigint").alias("line"), F.concat(F.lit('{"schema":"observations/1","session_id":"c-'), F.col("s").cast("string"), F.lit('","encoding":"ndjson","time_unit":"ns"}')).alias("value")),
        *[F.struct(F.lit(k).cast("bigint").alias("line"), F.lit(f'{{"type":"DefineFunction","id":"f{k}","name":"f{k}"}}').alias("value")) for k in (2, 3)],
    )
    heads = rows.select("s").distinct().select("s", F.inline(top))
    path = shared_path(spark, "canonical")
    body.unionByName(heads).repartition("s").sortWithinPartitions("s", "line").select("s", "value").write.partitionBy("s").text(path)
    found = canonical.records(spark, path)
    good = F.col("bad").isNull()
    counts = found.groupBy("session_id").agg(F.count_if(good & (F.col("role") == "observation")).alias("observations"), F.count_if(good & (F.col("role") == "dictionary")).cast("int").alias("entries"))
    return counts.join(canonical.faults(found).select("session_id", "reason", "code", F.col("ord").alias("line")), "session_id", "left")


def _le(x: Column, n: int) -> Column:
    """A whole number as n bytes in hexadecimal, lowest first."""
    return F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n)])


@query("""
WITH r AS (SELECT o_custkey % 6 AS s, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 6 ORDER BY o_orderkey) AS nth FROM orders),
o AS (SELECT s, CASE k % 4 WHEN 0 THEN 'Counter' WHEN 1 THEN 'Instant' WHEN 2 THEN 'SpanBegin' ELSE 'TraceGap' END AS type, CASE WHEN k % 4 = 0 THEN k * 3 - 50000 END AS value, CASE WHEN nth % 50 = 0 THEN 1 ELSE 0 END AS missing, nth + nth // 50 AS seq,
  k * 10 AS ticks, CASE WHEN k % 4 <> 3 THEN 'context:' || (k % 3) END AS context_id, CASE WHEN k % 4 = 1 THEN 'at T3PF' || k END AS name, CASE WHEN k % 4 = 3 THEN 'reported_drop:' || (k % 100) END AS reason FROM r)
SELECT 'w-' || s AS session_id, type, count(*) AS n, CAST(sum(value) AS DOUBLE) AS value, CAST(sum(missing) AS BIGINT) AS missing, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(ticks) AS BIGINT) AS ticks, max(context_id) AS context_id, max(name) AS name, max(reason) AS reason FROM o GROUP BY s, type
UNION ALL SELECT 'w-' || s, 'truncated_header', 1, NULL, NULL, count(*), count(*), NULL, NULL, NULL, NULL FROM r GROUP BY s""")
def binary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read of files of binary records, written first, by many tasks a file; their payloads look like records, and each file ends early."""
    k = F.col("k")
    rows = A.table(spark, sf_dir, "orders").selectExpr("concat('w-', o_custkey % 6) AS session_id", "CAST(o_orderkey AS BIGINT) AS k", "row_number() OVER (PARTITION BY o_custkey % 6 ORDER BY o_orderkey) AS nth")

    def header(kind: Column, size: Column, sequence: Column) -> Column:
        """A header without its mark."""
        zero = F.lit(0).cast("bigint")
        return F.concat(F.lit("01"), kind, _le(zero, 2), _le(size, 2), _le(zero, 2), _le(sequence, 4), _le(k * 10, 8), _le(k % 3, 4), _le(k % 5, 4))

    nth = F.col("nth").cast("bigint")
    inner = F.concat(F.hex(F.lit("T3PF")), header(F.lit("01"), F.lit(0).cast("bigint"), nth))
    payload = F.when(k % 4 == 0, _le(k * 3 - 50000, 8)).when(k % 4 == 1, F.hex(F.concat(F.lit("at T3PF"), k.cast("string")))).when(k % 4 == 2, inner).otherwise(_le(k % 100, 4))
    body = F.concat(header(F.get(F.lit(["04", "01", "02", "07"]), (k % 4).cast("int")), F.expr("CAST(length(payload) div 2 AS BIGINT)"), nth + F.floor(nth / 50)), F.col("payload"))
    raw = rows.withColumn("payload", payload).select("session_id", nth.alias("at"), F.unhex(body).cast("string").alias("value"))
    # the mark comes after each line, so an empty line first, and one mark too many at the end
    raw = raw.unionByName(rows.select("session_id").distinct().select("session_id", F.lit(0).cast("bigint").alias("at"), F.lit("").alias("value")))
    path = shared_path(spark, "binary")
    raw.repartition("session_id").sortWithinPartitions("session_id", "at").select("session_id", "value").write.partitionBy("session_id").option("lineSep", "T3PF").text(path)
    found = kept(wire.read_records(spark, path, 256, 4096), "records", unsized=True)  # read twice
    seen = wire.wire_observations(found)
    counted = seen.groupBy("session_id", "type").agg(
        F.count("*").alias("n"), F.sum("value").alias("value"), F.sum("missing").cast("bigint").alias("missing"), F.min("source_seq").alias("first_seq"), F.max("source_seq").alias("last_seq"), F.sum(F.col("ticks").cast("bigint")).alias("ticks"),
        F.max("context_id").alias("context_id"), F.max(F.when(F.col("type") == "Instant", F.col("name"))).alias("name"), F.max("reason").alias("reason"),
    )
    return counted.unionByName(found.where("bad IS NOT NULL").select("session_id", F.col("bad").alias("type"), F.lit(1).cast("bigint").alias("n"), F.col("ord").alias("first_seq"), F.col("ord").alias("last_seq")), allowMissingColumns=True)


# contracts of samples


@query("""
WITH b AS (SELECT p_size AS s, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) * 64 AS low, p_partkey AS k, p_partkey % 7 AS hits FROM part WHERE p_size % 17 <> 0),
e AS (SELECT *, low + CASE WHEN k % 97 = 0 THEN 96 WHEN k % 89 = 0 THEN 0 ELSE 64 END AS high FROM b), o AS (SELECT *, lag(high) OVER (PARTITION BY s ORDER BY low) > low AS overlap FROM e),
seen AS (SELECT s, sum(hits) AS hits, bool_or(coalesce(overlap, false)) AS overlap, bool_or(high <= low) AS empty FROM o GROUP BY s), d AS (SELECT DISTINCT p_size AS s FROM part), j AS (SELECT d.s AS size, seen.* FROM d LEFT JOIN seen ON d.s = seen.s)
SELECT 'h-' || size AS session_id, violation FROM (SELECT size, unnest([CASE WHEN s IS NULL THEN 'no_buckets' END, CASE WHEN overlap THEN 'overlapping_buckets' END, CASE WHEN empty THEN 'empty_bucket' END, CASE WHEN s IS NOT NULL AND size % 11 = 0 THEN 'hits_mismatch' END, CASE WHEN size % 13 = 0 THEN 'method_not_intrusive' END,
  CASE WHEN size % 19 = 0 THEN 'retained_percent' END, CASE WHEN size % 23 = 0 THEN 'empty_observed_time' END, CASE WHEN size % 7 = 0 THEN 'cleanup_incomplete' END, CASE WHEN size % 9 NOT IN (0, 1, 2, 3) THEN 'firmware_proof' END]) AS violation FROM j) WHERE violation IS NOT NULL""")
def histogram_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms made of parts, a size a capture, and what each breaks of the contract."""
    parts = A.table(spark, sf_dir, "part")
    buckets = parts.where("p_size % 17 <> 0").selectExpr("concat('h-', p_size) AS session_id", "row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) * 64 AS start", "p_partkey", "p_partkey % 7 AS hits")
    buckets = buckets.selectExpr("session_id", "start", "start + CASE WHEN p_partkey % 97 = 0 THEN 96 WHEN p_partkey % 89 = 0 THEN 0 ELSE 64 END AS end", "hits")
    total = parts.groupBy("p_size").agg(F.sum(F.expr("p_partkey % 7")).alias("hits"))
    status, proof = F.lit(["verified", "deployment_asserted", "mismatch", "unverified", "verified", "deployment_asserted", "mismatch", "unverified", "other"]), F.lit(["digest_bound_deployment", "precommitted_elf_assertion", "target_image_comparison", None, "precommitted_elf_assertion", None, "digest_bound_deployment", "target_image_comparison", None])
    nth = (F.col("p_size") % 9).cast("int")
    declared = total.select(
        F.expr("concat('h-', p_size)").alias("session_id"), F.expr("hits + if(p_size % 11 = 0, 1, 0)").alias("in_scope_hits"), F.expr("if(p_size % 2 = 1, 'stop_and_go', 'snoop')").alias("method"), F.expr("(p_size % 2 = 1) != (p_size % 13 = 0)").alias("intrusive"), F.expr("if(p_size % 19 = 0, 101.0, 95.0)").alias("retained_percent"),
        F.expr("if(p_size % 23 = 0, 0, 5)").alias("observed_ns"), F.expr("p_size % 7 != 0").alias("cleanup_complete"), F.get(status, nth).alias("firmware_status"), F.lit("ab").alias("elf_sha256"), F.get(proof, nth).alias("firmware_proof"),
    )
    return samples.histogram_violations(buckets, declared)


@query("""
WITH r AS (SELECT o_custkey % 40 AS s, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) + CASE WHEN o_custkey % 40 = 3 THEN 1 ELSE 0 END AS i, o_orderkey % 9 AS n, CASE WHEN o_custkey % 40 % 7 = 0 THEN 6 ELSE 8 END AS most FROM orders),
w AS (SELECT s, i, unnest([CASE WHEN s = 3 AND i = 2 THEN 'sample_index_not_contiguous' END, CASE WHEN n = 0 THEN 'empty_stack' END, CASE WHEN k % 61 = 0 AND n > 0 THEN 'depth_not_contiguous' END, CASE WHEN k % 3 = 0 THEN 'empty_halt' END, CASE WHEN n > most THEN 'too_many_frames' END, CASE WHEN k % 5 = 0 AND n <> most THEN 'ended_short_of_max_frames' END]) AS violation FROM r),
c AS (SELECT DISTINCT s FROM r)
SELECT 's-' || s AS session_id, i AS sample_index, violation FROM w WHERE violation IS NOT NULL UNION ALL SELECT 's-' || s, NULL, 'sample_counts' FROM c WHERE s % 11 = 0 UNION ALL SELECT 's-' || s, NULL, 'halt_sum' FROM c WHERE s % 13 = 0""")
def stack_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stack samples made of orders, and what each breaks of the contract."""
    rows = A.table(spark, sf_dir, "orders").selectExpr("o_custkey % 40 AS s", "o_orderkey AS k", "row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) + if(o_custkey % 40 = 3, 1, 0) AS sample_index", "CAST(o_orderkey % 9 AS INT) AS n")
    shown = rows.selectExpr(
        "concat('s-', s) AS session_id", "CAST(sample_index AS BIGINT) AS sample_index", "if(n = 0, CAST(array() AS array<string>), transform(sequence(1, n), x -> concat('f', x))) AS frames", "if(n = 0, CAST(array() AS array<int>), transform(sequence(0, n - 1), x -> CAST(if(k % 61 = 0, x + 1, x) AS INT))) AS depths",
        "if(k % 5 = 0, 'max_frames', 'terminal') AS termination", "k % 3 AS halt_ns",
    )
    captures = rows.groupBy("s").agg(F.count("*").alias("n"), F.sum(F.expr("k % 3")).alias("halted")).selectExpr(
        "concat('s-', s) AS session_id", "if(s % 7 = 0, 6, 8) AS max_frames", "n + if(s % 11 = 0, 1, 0) AS collected_samples", "n + 2 AS attempted_samples", "n + 5 AS max_samples", "halted + if(s % 13 = 0, 1, 0) AS total_halt_ns"
    )
    return stacks.sample_violations(shown, captures)
