"""Registered queries of fleets: all pairs of many captures, compared by every family of metrics at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import compare, samples
from spanloom.plans import adapters as A
from spanloom.plans.evidence import ORACLE_SQL, QUERIES
from spanloom.plans.registry import query

__all__ = ["ORACLE_SQL", "QUERIES"]

#: A fleet of captures: the lines of suppliers that agree in their last digits; every capture is compared with all later ones.
FLEET = 48
_POLICY = compare.Policy(share=0.2, exact_metrics=False, statistical_metrics=True, subject_set_changes=True)

_FLEET = f"""
line AS (SELECT l_suppkey % {FLEET} AS k, CASE WHEN l_suppkey % {FLEET} % 16 = 5 AND l_returnflag = 'A' THEN 'X' ELSE l_returnflag END AS f, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS p, 'p' || (l_partkey % 4) AS mode, l_linenumber AS nr FROM lineitem),
cap AS (SELECT DISTINCT k, CASE WHEN k % 13 = 0 THEN 'DEGRADED' ELSE 'VALID' END AS verdict FROM line),
pair AS (SELECT b.k AS b, c.k AS c, [x FOR x IN [CASE WHEN b.verdict <> 'VALID' THEN 'baseline_health_not_valid' END, CASE WHEN c.verdict <> 'VALID' THEN 'candidate_health_not_valid' END] IF x IS NOT NULL] AS reasons FROM cap b JOIN cap c ON b.k < c.k),
fit AS (SELECT b, c FROM pair WHERE len(reasons) = 0),
hot AS (SELECT k, f, unnest(['activations', 'inclusive_ns', 'self_ns', 'min_ns', 'max_ns', 'average_ns']) AS metric, unnest([n, s, h, lo, hi, s // n])::DOUBLE AS v FROM (SELECT k, f, count(*) AS n, sum(q)::BIGINT AS s, sum(q // 2)::BIGINT AS h, min(q) AS lo, max(q) AS hi FROM line GROUP BY k, f)),
fx AS (SELECT fit.b, fit.c, h.f, h.metric, h.v FROM fit JOIN hot h ON h.k = fit.b), fy AS (SELECT fit.b, fit.c, h.f, h.metric, h.v FROM fit JOIN hot h ON h.k = fit.c),
fun AS (SELECT coalesce(x.b, y.b) AS b, coalesce(x.c, y.c) AS c, 'function' AS family, coalesce(x.f, y.f) AS subject, coalesce(x.metric, y.metric) AS metric, x.v AS baseline, y.v AS candidate FROM fx x FULL JOIN fy y ON x.b = y.b AND x.c = y.c AND x.f = y.f AND x.metric = y.metric),
sampled AS (SELECT *, n / sum(n) OVER (PARTITION BY k) AS share FROM (SELECT k, mode, nr % 2 AS addr, count(*) AS n FROM line GROUP BY ALL)),
smp AS (SELECT fit.b, fit.c, 'sampling' AS family, x.mode AS subject, 'share' AS metric, x.share AS baseline, y.share AS candidate FROM fit JOIN sampled x ON x.k = fit.b JOIN sampled y ON y.k = fit.c AND y.mode = x.mode AND y.addr = x.addr),
keys AS (SELECT k, count(*) AS n FROM sampled GROUP BY k), common AS (SELECT b, c, count(*) AS n FROM smp GROUP BY b, c),
differ AS (SELECT b, c, 'function_set_differs' AS reason FROM fun WHERE baseline IS NULL OR candidate IS NULL
  UNION SELECT fit.b, fit.c, 'sampling_set_differs' FROM fit JOIN keys x ON x.k = fit.b JOIN keys y ON y.k = fit.c LEFT JOIN common m ON m.b = fit.b AND m.c = fit.c WHERE coalesce(m.n, 0) <> x.n OR coalesce(m.n, 0) <> y.n),
res AS (SELECT k, 's' || nr AS subject, CASE WHEN nr < 6 THEN 'heap.free_bytes' ELSE 'ram.current_used_bytes' END AS semantic, sum(p)::DOUBLE AS v FROM line GROUP BY ALL),
rx AS (SELECT fit.b, fit.c, r.* FROM fit JOIN res r ON r.k = fit.b), ry AS (SELECT fit.b, fit.c, r.* FROM fit JOIN res r ON r.k = fit.c),
rsc AS (SELECT coalesce(x.b, y.b) AS b, coalesce(x.c, y.c) AS c, 'resource' AS family, coalesce(x.subject, y.subject) AS subject, coalesce(x.semantic, y.semantic) AS metric, x.v AS baseline, y.v AS candidate FROM rx x FULL JOIN ry y ON x.b = y.b AND x.c = y.c AND x.subject = y.subject AND x.semantic = y.semantic),
rows AS (SELECT * FROM fun UNION ALL SELECT * FROM smp UNION ALL SELECT * FROM rsc),
judged AS (SELECT *, candidate - baseline AS delta, (candidate - baseline) / baseline AS relative, CASE WHEN metric = 'ram.current_used_bytes' THEN 'informational' WHEN baseline IS NULL OR candidate IS NULL THEN 'inconclusive'
  WHEN candidate = baseline OR baseline <> 0 AND abs((candidate - baseline) / baseline) <= CASE WHEN family = 'resource' AND subject <> 's1' THEN 0.3 ELSE 0.2 END THEN 'unchanged'
  WHEN family = 'resource' THEN CASE WHEN candidate > baseline THEN 'improved' ELSE 'regressed' END WHEN candidate > baseline THEN 'regressed' ELSE 'improved' END AS outcome FROM rows)"""


def _fleet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("l_suppkey") % FLEET
    lines = A.table(spark, sf_dir, "lineitem").select(
        k.alias("k"), F.concat(F.lit("d-"), k.cast("string")).alias("session_id"), F.when((k % 16 == 5) & (F.col("l_returnflag") == "A"), "X").otherwise(F.col("l_returnflag")).alias("function_id"), F.col("l_quantity").cast("bigint").alias("ns"),
        F.floor("l_extendedprice").cast("bigint").alias("bytes"), F.concat(F.lit("p"), (F.col("l_partkey") % 4).cast("string")).alias("place"), (F.col("l_linenumber") % 2).cast("bigint").alias("address"), F.col("l_linenumber").alias("nr"),
    )
    captures = lines.select("k", "session_id").distinct().selectExpr("k", "session_id", "if(k % 13 = 0, 'DEGRADED', 'VALID') AS verdict", "'exact' AS call_count", "'exact' AS active_time", "'exact' AS self_time")
    # the captures are at most FLEET rows, whatever the tables hold
    later = captures.select(F.col("k").alias("later"), F.col("session_id").alias("candidate_id"))
    pairs = captures.join(F.broadcast(later), F.col("k") < F.col("later")).select(F.col("session_id").alias("baseline_id"), "candidate_id")
    hot = lines.groupBy("session_id", "function_id").agg(F.count("*").alias("activations"), F.sum("ns").alias("inclusive_ns"), F.sum(F.expr("ns div 2")).alias("self_ns"), F.min("ns").alias("min_ns"), F.max("ns").alias("max_ns")).withColumn("average_ns", F.expr("inclusive_ns div activations"))
    sampled = samples.sampling_hotspots(lines.select("session_id", F.col("place").alias("function_id"), "address", F.lit(None).cast("string").alias("context_id"), F.lit(None).cast("bigint").alias("weight_ns")))
    subject = F.concat(F.lit("s"), F.col("nr").cast("string"))
    resources = lines.groupBy("session_id", "nr").agg(F.sum("bytes").cast("double").alias("value")).select("session_id", F.concat(F.lit("c"), F.col("nr").cast("string")).alias("counter_id"), F.when(F.col("nr") < 6, "heap.free_bytes").otherwise("ram.current_used_bytes").alias("semantic"), subject.alias("subject"), "value")
    rules = spark.createDataFrame([("heap.free_bytes", None, 0.0, 0.3, False), ("heap.free_bytes", "s1", 0.0, 0.2, False)], "semantic string, subject string, absolute double, share double, lower_is_better boolean")
    return compare.compare_fleet(pairs, captures.drop("k"), hot, _POLICY, sampled, resources, rules)


@query(f"""
WITH {_FLEET}, n AS (SELECT b, c, count(*) FILTER (outcome = 'regressed') AS regressed, count(*) FILTER (outcome = 'inconclusive') AS inconclusive, count(*) FILTER (outcome = 'improved') AS improved, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'informational') AS informational FROM judged GROUP BY b, c),
d AS (SELECT b, c, list(reason ORDER BY reason) AS more FROM differ GROUP BY b, c),
j AS (SELECT p.b, p.c, list_concat(p.reasons, coalesce(d.more, [])) AS reasons, coalesce(regressed, 0) AS regressed, coalesce(inconclusive, 0) AS inconclusive, coalesce(improved, 0) AS improved, coalesce(unchanged, 0) AS unchanged, coalesce(informational, 0) AS informational FROM pair p LEFT JOIN n ON n.b = p.b AND n.c = p.c LEFT JOIN d ON d.b = p.b AND d.c = p.c)
SELECT 'd-' || b AS baseline_id, 'd-' || c AS candidate_id, CASE WHEN len(reasons) > 0 OR inconclusive > 0 THEN 'inconclusive' WHEN regressed > 0 THEN 'regressed' WHEN improved > 0 THEN 'improved' ELSE 'unchanged' END AS verdict, reasons, regressed, inconclusive, improved, unchanged, informational FROM j""")
def fleet_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict on functions, sampled places and resources of each pair of captures of a fleet."""
    return _fleet(spark, sf_dir)[1]


@query(f"WITH {_FLEET} SELECT 'd-' || b AS baseline_id, 'd-' || c AS candidate_id, family, subject, metric, CASE WHEN baseline IS NULL THEN 'candidate_only' WHEN candidate IS NULL THEN 'baseline_only' ELSE 'both' END AS side, baseline, candidate, delta, relative, outcome FROM judged")
def fleet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows behind the verdicts of a fleet, of all families in one form."""
    return _fleet(spark, sf_dir)[0].drop("context_id")
