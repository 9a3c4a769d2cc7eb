"""Baseline against candidate: metric rows, outcomes, verdicts, and checks against reference statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.scalar import OUTCOME, delta, outcome, rank, relative, within
from spanloom.functions.tables import kept
from spanloom.operators.coverage import compare_static_ram


def compare_metrics(baseline: DataFrame, candidate: DataFrame, keys: list[str], metrics: list[str], absolute: float = 0.0, share: float = 0.05) -> DataFrame:
    """A row for each key and metric of a null-safe full outer join; a missing side is inconclusive."""
    b, c = baseline.alias("b"), candidate.alias("c")
    same = None
    for k in keys:
        one = F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}"))
        same = one if same is None else same & one
    both = b.withColumn("in_b", F.lit(True)).alias("b").join(c.withColumn("in_c", F.lit(True)).alias("c"), same, "full")
    side = F.when(F.col("in_b").isNull(), "candidate_only").when(F.col("in_c").isNull(), "baseline_only").otherwise("both")
    rows = both.select(*[F.coalesce(f"b.{k}", f"c.{k}").alias(k) for k in keys], side.alias("side"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b.{m}").cast("double").alias("baseline"), F.col(f"c.{m}").cast("double").alias("candidate")) for m in metrics])).alias("m"))
    rows = rows.select(*keys, "side", "m.*")
    x, y = F.col("baseline"), F.col("candidate")
    return rows.withColumn("delta", delta(x, y)).withColumn("relative", relative(x, y)).withColumn("outcome", outcome(x, y, absolute, share))


def with_rules(rows: DataFrame, exact: DataFrame, wide: DataFrame) -> DataFrame:
    """The rule for the exact subject, else the one for the whole semantic, as a struct ``rule`` of the rules' other columns."""

    def values(df: DataFrame, name: str) -> Column:
        return F.struct(*[c for c in df.columns if c not in ("semantic", "subject")]).alias(name)

    a = exact.select("semantic", "subject", values(exact, "exact_rule"))
    b = wide.select("semantic", values(wide, "wide_rule"))
    found = rows.join(a, ["semantic", "subject"], "left").join(b, "semantic", "left")
    return found.withColumn("rule", F.coalesce("exact_rule", "wide_rule")).drop("exact_rule", "wide_rule")


def comparison_verdict(rows: DataFrame, pairs: DataFrame, pair: list[str]) -> DataFrame:
    """One verdict a pair: reasons first, then nothing in common, inconclusive, regressed, improved, unchanged.

    ``pairs`` has the pair's columns and an array of reasons for which it cannot be compared.
    """
    flags = rows.groupBy(*pair).agg(*[F.bool_or(F.col("outcome") == o).alias(o) for o in ("inconclusive", "regressed", "improved")], F.bool_or(F.col("side") == "both").alias("common"))
    both = pairs.join(flags, pair, "left")
    verdict = F.when(F.size("reasons") > 0, "inconclusive").when(~F.coalesce("common", F.lit(False)), "inconclusive").when(F.col("inconclusive"), "inconclusive").when(F.col("regressed"), "regressed").when(F.col("improved"), "improved").otherwise("unchanged")
    reasons = F.when((F.size("reasons") == 0) & ~F.coalesce("common", F.lit(False)), F.array(F.lit("no_common_metrics"))).otherwise(F.col("reasons"))
    return both.select(*pair, verdict.alias("verdict"), reasons.alias("reasons"))


def outcome_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOME])


def ranked_rows(rows: DataFrame, by: list[str], ids: list[str], n: int) -> DataFrame:
    """The n most telling rows of each pair: by outcome, then by magnitude, then by id."""
    order = Window.partitionBy(*by).orderBy(rank(F.col("outcome"), OUTCOME), F.desc(F.abs(F.coalesce("relative", "delta"))), *ids)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


@dataclass(frozen=True)
class Policy:
    """What two captures must have in common to be compared, and what counts as a change."""

    absolute: float = 0.0
    share: float = 0.05
    complete_provenance: bool = False
    same_health_policy: bool = True
    same_tool: bool = True
    same_adapter_version: bool = True
    same_firmware: bool = False
    same_request: bool = True
    exact_metrics: bool = True
    statistical_metrics: bool = False
    subject_set_changes: bool = False


STRICT = Policy(complete_provenance=True, same_firmware=True)
RELAXED = Policy(same_health_policy=False, same_tool=False, same_adapter_version=False, same_request=False, exact_metrics=False, statistical_metrics=True, subject_set_changes=True)

#: Facts of a capture that ``comparability`` looks at; a side without a column has null.
FACTS = {
    "session_id": "string", "health_session_id": "string", "hotspots_session_id": "string", "summary_session_id": "string", "verdict": "string", "summary_verdict": "string", "policy_version": "string", "tool_name": "string", "tool_version": "string",
    "mode": "string", "adapter_id": "string", "adapter_version": "string", "provider": "string", "covered_cores": "array<bigint>", "capabilities": "string", "config_artifact_id": "string", "config_sha256": "string", "architecture": "string", "device": "string",
    "board": "string", "core_count": "bigint", "clocks": "array<struct<id:string,frequency_hz:bigint>>", "firmware": "string", "debugger": "string", "request_sha256": "string", "call_count": "string", "active_time": "string", "self_time": "string", "least_quality": "string",
}


def sides(captures: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(baseline_id, candidate_id)`` with the facts of both captures as structs; absent captures have null facts."""
    whole = captures.select(*[(F.col(c) if c in captures.columns else F.lit(None)).cast(t).alias(c) for c, t in FACTS.items()])
    for side in ("baseline", "candidate"):
        one = whole.select(F.col("session_id").alias(f"{side}_id"), F.struct(*FACTS).alias(side))
        pairs = pairs.join(one, f"{side}_id", "left")
    return pairs


def comparability(pairs: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008  a frozen value
    """Reasons, in fixed order and each once, why the two captures of a pair (``sides``) cannot be compared."""

    def b(c: str) -> Column:
        return F.col(f"baseline.{c}")

    def c(name: str) -> Column:
        return F.col(f"candidate.{name}")

    def differ(name: str) -> Column:
        return ~b(name).eqNullSafe(c(name))

    def absent(name: str, either: bool = True) -> Column:
        x, y = F.coalesce(b(name), F.lit("")) == "", F.coalesce(c(name), F.lit("")) == ""
        return x | y if either else x & y

    reasons: list[Column] = []

    def when(condition: Column, reason: str) -> None:
        reasons.append(F.when(condition, F.lit(reason)))

    if not 0 <= policy.share < float("inf") or not 0 <= policy.absolute < float("inf"):
        when(F.lit(True), "comparison_policy_invalid")
    for side, of in (("baseline", b), ("candidate", c)):
        when(of("session_id").isNull(), f"{side}_manifest_invalid")
        for part in ("health", "hotspots", "summary"):
            when(of(f"{part}_session_id").isNotNull() & (of(f"{part}_session_id") != of("session_id")), f"{side}_{part}_session_mismatch")
        when(~of("verdict").eqNullSafe("VALID"), f"{side}_health_not_valid")
        when(of("summary_verdict").isNotNull() & (of("summary_verdict") != "VALID"), f"{side}_summary_not_valid")
        when(of("summary_verdict").isNotNull() & ~of("summary_verdict").eqNullSafe(of("verdict")), f"{side}_summary_health_mismatch")
    if policy.same_health_policy:
        when(differ("policy_version"), "health_policy_version_mismatch")
    if policy.same_tool:
        when(differ("tool_name") | differ("tool_version"), "tool_contract_mismatch")
    complete = policy.complete_provenance
    if complete:
        when(absent("mode") | absent("adapter_id") | absent("adapter_version"), "capture_identity_incomplete")
    # what only one side or none tells is incomplete; what both tell must be equal
    for reason, names in (("capture_provider", ("provider",)), ("capture_capabilities", ("capabilities",)), ("capture_config_artifact", ("config_artifact_id",)), ("capture_config_digest", ("config_sha256",))):
        for name in names:
            when(b(name).isNotNull() & c(name).isNotNull() & (b(name) != c(name)), f"{reason}_mismatch")
            if complete:
                when(b(name).isNull() | c(name).isNull(), f"{reason}_incomplete")
    cores = [F.array_sort(F.array_distinct(F.coalesce(of("covered_cores"), F.array().cast("array<bigint>")))) for of in (b, c)]
    some = (F.size(cores[0]) > 0) & (F.size(cores[1]) > 0)
    when(some & (cores[0] != cores[1]), "capture_core_coverage_mismatch")
    if complete:
        when(~some, "capture_core_coverage_incomplete")
    when(differ("mode"), "capture_mode_mismatch")
    when(differ("adapter_id"), "capture_adapter_mismatch")
    if policy.same_adapter_version:
        when(differ("adapter_version"), "capture_adapter_version_mismatch")
    target = differ("architecture") | differ("device") | differ("board") | differ("core_count")
    if complete:
        target |= absent("architecture") | absent("device") | (F.coalesce(b("core_count"), F.lit(0)) == 0) | (F.coalesce(c("core_count"), F.lit(0)) == 0)
    when(target, "capture_target_mismatch")
    clocks = [F.array_sort(F.coalesce(of("clocks"), F.array().cast(FACTS["clocks"]))) for of in (b, c)]
    clock = clocks[0] != clocks[1]
    if complete:
        clock |= (F.size(clocks[0]) == 0) | F.exists(clocks[0], lambda x: x["frequency_hz"].isNull())
    when(clock, "capture_clock_mismatch")
    if complete:
        when(absent("firmware"), "capture_firmware_identity_incomplete")
    if policy.same_firmware:
        when(absent("firmware") | differ("firmware"), "capture_firmware_mismatch")
    when(differ("debugger") | (absent("debugger") if complete else F.lit(False)), "capture_debugger_mismatch")
    both = b("request_sha256").isNotNull() & c("request_sha256").isNotNull()
    request = both & (b("request_sha256") != c("request_sha256")) if policy.same_request else F.lit(False)
    if complete:
        request |= ~both
    elif policy.same_request:
        request |= b("request_sha256").isNull() != c("request_sha256").isNull()
    when(request, "capture_request_mismatch")
    for name in ("call_count", "active_time", "self_time"):
        unlike = differ(name) | b(name).eqNullSafe("unavailable")
        if policy.exact_metrics:
            unlike |= ~b(name).eqNullSafe("exact")
        when(unlike, f"metric_support_mismatch:{name}")
    if policy.exact_metrics:
        when(~F.coalesce(b("least_quality"), F.lit("exact")).eqNullSafe("exact") | ~F.coalesce(c("least_quality"), F.lit("exact")).eqNullSafe("exact"), "function_hotspot_quality_not_exact")
    return pairs.withColumn("reasons", F.array_distinct(F.array_compact(F.array(*reasons))))


def _of_pairs(pairs: DataFrame, rows: DataFrame, side: str) -> DataFrame:
    return pairs.select("baseline_id", "candidate_id", F.col(f"{side}_id").alias("session_id")).join(rows, "session_id").drop("session_id")


def set_differences(pairs: DataFrame, rows: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Pairs of captures whose rows do not have the same keys, with the reason; nulls are keys too."""
    key = F.struct(*keys)
    b, c = (_of_pairs(pairs, rows, side).select("baseline_id", "candidate_id", key.alias("key")).distinct() for side in ("baseline", "candidate"))
    either = b.withColumn("side", F.lit(1)).unionByName(c.withColumn("side", F.lit(2))).groupBy("baseline_id", "candidate_id", "key").agg(F.sum("side").alias("sides"))
    return either.where("sides < 3").select("baseline_id", "candidate_id", F.lit(reason).alias("reason")).distinct()


def compare_sampling(pairs: DataFrame, sampled: DataFrame, policy: Policy = RELAXED) -> DataFrame:
    """Shares of each sampled place that both captures of a pair have; only where the policy takes statistics."""
    if policy.exact_metrics or not policy.statistical_metrics:
        pairs = pairs.where("false")
    keys = ["function_id", "address", "context_id"]
    b, c = (_of_pairs(pairs, sampled.select("session_id", *keys, F.col("share").alias(side)), side).alias(side[0]) for side in ("baseline", "candidate"))
    same = F.lit(True)
    for k in ("baseline_id", "candidate_id", *keys):
        same &= F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}"))
    both = b.join(c, same).select("b.*", "c.candidate")
    x, y = F.col("baseline"), F.col("candidate")
    subject = F.coalesce("function_id", F.concat(F.lit("address:"), F.lower(F.hex("address"))))
    return both.select("baseline_id", "candidate_id", subject.alias("subject"), "context_id", x, y, delta(x, y).alias("delta"), relative(x, y).alias("relative"), outcome(x, y, 0.0, policy.share).alias("outcome"))


def compare_resources(pairs: DataFrame, resources: DataFrame, rules: DataFrame, policy: Policy = RELAXED) -> tuple[DataFrame, DataFrame]:
    """Rows of what the rules name, by (semantic, subject), and reasons why a pair's resources cannot be compared.

    ``resources``: session_id, counter_id, semantic, subject, value. ``rules``: semantic, subject (null: any), absolute,
    share, lower_is_better. A counter id that means one thing on one side and another on the other excludes both.
    """
    b, c = (_of_pairs(pairs, resources.select("session_id", "counter_id", "semantic", "subject", F.col("value").alias(side)), side) for side in ("baseline", "candidate"))
    pair = ["baseline_id", "candidate_id"]
    mine = b.select(*pair, "counter_id", F.struct("semantic", "subject").alias("is_b"))
    theirs = c.select(*pair, "counter_id", F.struct("semantic", "subject").alias("is_c"))
    reused = mine.join(theirs, [*pair, "counter_id"]).where("is_b <> is_c")
    barred = reused.select(*pair, F.explode(F.array("is_b", "is_c")).alias("is")).select(*pair, "is.*").distinct()
    both = b.drop("counter_id").join(c.drop("counter_id"), [*pair, "semantic", "subject"], "full").join(barred, [*pair, "semantic", "subject"], "left_anti")
    ruled = with_rules(both, rules.where("subject IS NOT NULL"), rules.where("subject IS NULL").drop("subject"))
    x, y = F.col("baseline"), F.col("candidate")
    changed = (F.abs(delta(x, y)) > F.col("rule.absolute")) & ((x == 0) | (F.abs(relative(x, y)) > F.col("rule.share")))
    worse = (delta(x, y) > 0) == F.col("rule.lower_is_better")
    judged = F.when(F.col("rule").isNull(), "informational").when(x.isNull() | y.isNull(), "inconclusive").when(~changed, "unchanged").when(worse, "regressed").otherwise("improved")
    rows = ruled.select(*pair, "semantic", "subject", x, y, delta(x, y).alias("delta"), relative(x, y).alias("relative"), judged.alias("outcome"))
    identity = reused.select(*pair, F.concat(F.lit("resource_counter_identity_mismatch:"), "counter_id").alias("reason"))
    if policy.subject_set_changes:
        return rows, identity.distinct()
    sets = ruled.where("rule IS NOT NULL AND (baseline IS NULL OR candidate IS NULL)").select(*pair, F.concat(F.lit("resource_subject_set_differs:"), "semantic").alias("reason"))
    return rows, identity.unionByName(sets).distinct()


def compare_captures(pairs: DataFrame, captures: DataFrame, hotspots: DataFrame, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:  # noqa: B008  a frozen value
    """Metric rows of every pair of captures, and a verdict with reasons for each.

    ``pairs(baseline_id, candidate_id)`` may hold one pair or all pairs of a fleet; a pair with reasons has no rows.
    """
    judged = comparability(sides(captures, pairs), policy)
    more = set_differences(pairs, hotspots, ["function_id"], "function_set_differs").groupBy("baseline_id", "candidate_id").agg(F.collect_set("reason").alias("more"))
    judged = judged.join(more, ["baseline_id", "candidate_id"], "left").withColumn("reasons", F.array_union("reasons", F.coalesce("more", F.array().cast("array<string>")))).select("baseline_id", "candidate_id", "reasons")
    fit = judged.where("size(reasons) = 0")
    metrics = ["activations", "inclusive_ns", "self_ns", "min_ns", "max_ns", "average_ns"]
    b, c = (_of_pairs(fit, hotspots, side) for side in ("baseline", "candidate"))
    rows = compare_metrics(b, c, ["baseline_id", "candidate_id", "function_id"], metrics, policy.absolute, policy.share)
    return rows, comparison_verdict(rows, judged, ["baseline_id", "candidate_id"])


FAMILY = ("baseline_id", "candidate_id", "family", "subject", "context_id", "metric", "side", "baseline", "candidate", "delta", "relative", "outcome")


def compare_fleet(
    pairs: DataFrame, captures: DataFrame, hotspots: DataFrame, policy: Policy = Policy(), sampled: DataFrame | None = None, resources: DataFrame | None = None, rules: DataFrame | None = None, static_ram: DataFrame | None = None  # noqa: B008  a frozen value
) -> tuple[DataFrame, DataFrame]:
    """Rows of every family of metrics of many pairs of captures in one form (``FAMILY``), and one verdict a pair over them all.

    ``pairs(baseline_id, candidate_id)``: one pair, or all of a fleet. ``hotspots``: session_id, function_id, optionally
    context_id, and six metrics; ``sampled``: as of ``sampling_hotspots``; ``resources`` with ``rules``: as of
    ``compare_resources``; ``static_ram``: session_id and bytes by kind. A pair that its captures' facts bar has reasons and no
    rows. Sets of functions, sampled places or subjects that differ are reasons, too, but leave the rows. Rows without a rule
    (informational) have no say in the verdict. A family that is not given is not compared. Work and what is shuffled grow
    with the rows that come out: each capture's rows go to its pairs once a family.
    """
    pair = ["baseline_id", "candidate_id"]
    judged = kept(comparability(sides(captures, pairs.distinct()), policy).select(*pair, "reasons"), "pairs")
    fit = judged.where("size(reasons) = 0").select(*pair)
    keys = ["function_id", *[c for c in ("context_id",) if c in hotspots.columns]]
    metrics = ["activations", "inclusive_ns", "self_ns", "min_ns", "max_ns", "average_ns"]
    none = F.lit(None).cast("string")

    def form(rows: DataFrame, family: str, **named: Column) -> DataFrame:
        have = {"family": F.lit(family), "context_id": F.col("context_id") if "context_id" in rows.columns else none, "side": F.col("side") if "side" in rows.columns else F.lit("both")} | named
        return rows.select(*[have[c].alias(c) if c in have else F.col(c) for c in FAMILY])

    own = hotspots.select("session_id", *keys, *metrics)
    b, c = (_of_pairs(fit, own, side) for side in ("baseline", "candidate"))
    found = form(compare_metrics(b, c, [*pair, *keys], metrics, policy.absolute, policy.share), "function", subject=F.col("function_id"))
    more = None
    if sampled is not None and policy.statistical_metrics and not policy.exact_metrics:
        found = found.unionByName(form(compare_sampling(fit, sampled, policy), "sampling", metric=F.lit("share")))
        more = set_differences(fit, sampled, ["function_id", "address", "context_id"], "sampling_set_differs")
    if resources is not None and rules is not None:
        rows, reasons = compare_resources(fit, resources, rules, policy)
        side = F.when(F.col("baseline").isNull(), "candidate_only").when(F.col("candidate").isNull(), "baseline_only").otherwise("both")
        found = found.unionByName(form(rows, "resource", metric=F.col("semantic"), side=side))
        more = reasons if more is None else more.unionByName(reasons)
    if static_ram is not None:
        b, c = (_of_pairs(fit, static_ram, side) for side in ("baseline", "candidate"))
        found = found.unionByName(form(compare_static_ram(b, c, pair), "static_ram", subject=none, metric=F.col("kind")))
    # the rows are written once; verdicts and whoever reads the rows take them from there
    found = kept(found, "fleet-rows")
    counted = found.groupBy(*pair).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOME])
    # one-sided functions are where their sets differ
    apart = found.where("family = 'function' AND side <> 'both'").select(*pair, F.lit("function_set_differs").alias("reason"))
    more = apart if more is None else more.unionByName(apart)
    said = more.groupBy(*pair).agg(F.array_sort(F.collect_set("reason")).alias("more"))
    both = judged.join(counted, pair, "left").fillna(0, [*OUTCOME]).join(said, pair, "left")
    reasons = F.array_union("reasons", F.coalesce("more", F.array().cast("array<string>")))
    empty = (F.size(reasons) == 0) & (F.col("inconclusive") + F.col("regressed") + F.col("improved") + F.col("unchanged") == 0)
    reasons = F.when(empty, F.array(F.lit("no_common_metrics"))).otherwise(reasons)
    verdict = F.when(F.size(reasons) > 0, "inconclusive").when(F.col("inconclusive") > 0, "inconclusive").when(F.col("regressed") > 0, "regressed").when(F.col("improved") > 0, "improved").otherwise("unchanged")
    return found, both.select(*pair, verdict.alias("verdict"), reasons.alias("reasons"), *OUTCOME)


def selected_activations(spans: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The activations that ``chosen(session_id, source_id, source_seq_start, source_seq_end)`` names, and those it names that are none."""
    keys = ["session_id", "source_id", "source_seq_start", "source_seq_end"]
    return spans.join(chosen, keys, "left_semi"), chosen.join(spans, keys, "left_anti")


def against_reference(found: DataFrame, reference: DataFrame, keys: list[str], counts: list[str], times: list[str], tick_ns: float = 1.0, share: float = 0.005) -> DataFrame:
    """Checks against reference statistics: ids as sets, counts exactly, times within max(share, one tick)."""
    both = found.withColumn("found", F.lit(True)).alias("f").join(reference.withColumn("expected", F.lit(True)).alias("r"), keys, "full")
    checks = [F.struct(F.lit("presence").alias("check"), (F.col("found") & F.col("expected")).alias("ok"), F.lit(None).cast("double").alias("error"), F.lit(None).cast("double").alias("relative_error"))]

    def errors(m: str) -> list[Column]:
        off = F.abs(F.col(f"f.{m}") - F.col(f"r.{m}")).cast("double")
        return [off.alias("error"), F.when(F.col(f"r.{m}") != 0, off / F.abs(F.col(f"r.{m}"))).alias("relative_error")]

    for m in counts:
        checks.append(F.struct(F.lit(m).alias("check"), (F.col(f"f.{m}") == F.col(f"r.{m}")).alias("ok"), *errors(m)))
    for m in times:
        checks.append(F.struct(F.lit(m).alias("check"), within(F.col(f"f.{m}"), F.col(f"r.{m}"), tick_ns, share).alias("ok"), *errors(m)))
    rows = both.select(*keys, F.explode(F.array(*checks)).alias("c")).select(*keys, "c.*")
    return rows.withColumn("ok", F.coalesce("ok", F.lit(False)))


def check_report(checks: DataFrame) -> DataFrame:
    """Checks, passed and failed ones, and the worst errors of each category."""
    return checks.groupBy("check").agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.max("error").alias("worst_error"), F.max("relative_error").alias("worst_relative_error"))


def first_failures(checks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n failed checks of each category that come first by their keys."""
    order = Window.partitionBy("check").orderBy(*keys)
    return checks.where("NOT ok").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def resource_reference(found: DataFrame, reference: DataFrame, tolerances: DataFrame) -> DataFrame:
    """Resource values against reference values by (session_id, semantic, subject), each within its unit's tolerance.

    ``found`` and ``reference`` have unit and value; ``tolerances``: unit, absolute, share. A unit without one must be equal.
    """
    keys = ["session_id", "semantic", "subject"]
    both = found.select(*keys, "unit", "value").join(reference.select(*keys, F.col("unit").alias("due_unit"), F.col("value").alias("due")), keys, "full")
    both = both.withColumn("of", F.coalesce("unit", "due_unit")).join(tolerances.withColumnRenamed("unit", "of"), "of", "left").fillna(0.0, ["absolute", "share"])
    ok = F.col("unit").eqNullSafe(F.col("due_unit")) & (F.abs(F.col("value") - F.col("due")) <= F.greatest(F.col("absolute"), F.abs("due") * F.col("share")))
    error = F.abs(F.col("value") - F.col("due"))
    return both.select(*keys, F.col("of").alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), error.alias("error"), F.when(F.col("due") != 0, error / F.abs("due")).alias("relative_error"))


def positional(found: DataFrame, reference: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Two sequences compared place by place; a place that only one side has differs."""
    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).select(*by, "place", F.struct(*columns).alias(name))

    both = numbered(found, "found").join(numbered(reference, "expected"), [*by, "place"], "full")
    return both.withColumn("same", F.col("found").eqNullSafe(F.col("expected")))
