"""Program-counter samples: attribution to functions, hotspots, histograms, heatmaps and flat profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.scalar import share_of

#: Width of the address cells by which ranges and addresses meet.
CELL = 1 << 12


def range_violations(ranges: DataFrame) -> DataFrame:
    """Empty or overlapping ranges of (session_id, function_id, start, end)."""
    order = Window.partitionBy("session_id").orderBy("start", "end")
    found = ranges.withColumn("next_start", F.lead("start").over(order))
    return found.where("end <= start OR next_start < end").select("session_id", "function_id", "start", "end", F.when(F.col("end") <= F.col("start"), "empty_range").otherwise("overlapping_range").alias("violation"))


def attribute(samples: DataFrame, ranges: DataFrame, cell: int = CELL) -> DataFrame:
    """Left join of each address to the half-open range that holds it, as an equi-join on cells.

    A range is listed under every cell it touches; an address has one cell. So neither side needs to fit
    into memory and no pair outside a shared cell is looked at.
    """
    listed = ranges.select("session_id", "function_id", "start", "end", F.explode(F.sequence(F.expr(f"start div {cell}"), F.expr(f"(end - 1) div {cell}"))).alias("cell"))
    placed = samples.withColumn("cell", F.expr(f"address div {cell}"))
    a, b = placed.alias("a"), listed.alias("b")
    held = (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.address") >= F.col("b.start")) & (F.col("a.address") < F.col("b.end"))
    return a.join(b, held, "left").select(*[F.col(f"a.{c}") for c in samples.columns], F.col("b.function_id").alias("range_function_id"))


def symbol_conflicts(attributed: DataFrame) -> DataFrame:
    """Samples whose own symbol and address name different functions."""
    return attributed.where("function_id IS NOT NULL AND range_function_id IS NOT NULL AND function_id <> range_function_id")


def sampling_hotspots(samples: DataFrame) -> DataFrame:
    """Count, weight and share of each (function, address, context); a sample without weight weighs 1."""
    found = samples.groupBy("session_id", "function_id", "address", "context_id").agg(F.count("*").alias("samples"), F.sum(F.coalesce("weight_ns", F.lit(1)).cast("decimal(38,0)")).alias("weight"))
    total = found.groupBy("session_id").agg(F.sum("weight").alias("total"))
    return found.join(total, "session_id").withColumn("share", share_of(F.col("weight").cast("double"), F.col("total").cast("double"))).drop("total")


def bucketed(samples: DataFrame, regions: DataFrame, width: int) -> DataFrame:
    """Hits of fixed-width buckets over (session_id, start, end); the last one is clipped, empty ones stay."""
    buckets = regions.select("session_id", "start", "end", F.explode(F.expr(f"sequence(0, (end - start - 1) div {width})")).alias("i"))
    buckets = buckets.select("session_id", F.col("start").alias("base"), (F.col("start") + F.col("i") * width).alias("start"), F.least(F.col("start") + (F.col("i") + 1) * width, F.col("end")).alias("end"))
    inside = samples.join(regions, "session_id").where("address >= start AND address < end").select("session_id", F.expr(f"start + (address - start) div {width} * {width}").alias("start"))
    hits = inside.groupBy("session_id", "start").agg(F.count("*").alias("hits"))
    return buckets.join(hits, ["session_id", "start"], "left").select("session_id", "start", "end", F.coalesce("hits", F.lit(0)).alias("hits"))


def function_heatmap(buckets: DataFrame, ranges: DataFrame) -> DataFrame:
    """Hits of each function over the buckets that lie whole inside it; a null function holds the rest."""
    placed = attribute(buckets.withColumn("address", F.col("start")), ranges)
    whole = placed.join(ranges.select("session_id", F.col("function_id").alias("range_function_id"), F.col("start").alias("f_start"), F.col("end").alias("f_end")), ["session_id", "range_function_id"], "left")
    owner = F.when((F.col("f_start") <= F.col("start")) & (F.col("end") <= F.col("f_end")), F.col("range_function_id"))
    return whole.groupBy("session_id", owner.alias("function_id")).agg(F.sum("hits").alias("hits")).where("hits > 0")


def heatmap_accounting(cells: DataFrame, buckets: DataFrame) -> DataFrame:
    """Attributed and unattributed hits of each session against the histogram's."""
    own = cells.groupBy("session_id").agg(F.coalesce(F.sum(F.when(F.col("function_id").isNotNull(), F.col("hits"))), F.lit(0)).alias("attributed"), F.coalesce(F.sum(F.when(F.col("function_id").isNull(), F.col("hits"))), F.lit(0)).alias("unattributed"))
    total = buckets.groupBy("session_id").agg(F.sum("hits").alias("denominator"))
    return total.join(own, "session_id", "left").fillna(0, ["attributed", "unattributed"]).withColumn("balanced", F.col("attributed") + F.col("unattributed") == F.col("denominator"))


#: The proofs that each firmware status may have; a status without any may have none.
FIRMWARE_PROOFS = {"verified": ["digest_bound_deployment", "target_image_comparison"], "deployment_asserted": ["precommitted_elf_assertion"], "mismatch": ["target_image_comparison"], "unverified": []}


def histogram_violations(buckets: DataFrame, declared: DataFrame) -> DataFrame:
    """session_id and violation: everything by which a histogram breaks its contract.

    ``buckets(session_id, start, end, hits)`` must be half open and disjoint, and their hits must sum to what
    ``declared`` says. Of ``declared`` (session_id, in_scope_hits, and where known method, intrusive, retained_percent,
    requested_ns, observed_ns, cleanup_complete, firmware_status, elf_sha256, firmware_proof): only stopping is intrusive,
    durations are above zero, percentages in 0 to 100, cleanup has ended, and a firmware status has its digest and proof.
    """
    order = Window.partitionBy("session_id").orderBy("start", "end")
    judged = buckets.withColumn("overlap", F.coalesce(F.lag("end").over(order) > F.col("start"), F.lit(False)))
    seen = judged.groupBy(F.col("session_id").alias("of")).agg(F.sum("hits").alias("hits"), F.max("overlap").alias("overlap"), F.max(F.col("end") <= F.col("start")).alias("empty"))
    rows = declared.join(seen, F.col("session_id").eqNullSafe(F.col("of")), "left")
    have = set(declared.columns)
    rules = {"no_buckets": F.col("of").isNull() & F.col("hits").isNull(), "overlapping_buckets": F.col("overlap"), "empty_bucket": F.col("empty"), "hits_mismatch": F.col("hits") != F.col("in_scope_hits")}
    if {"method", "intrusive"} <= have:
        rules["method_not_intrusive"] = (F.col("method") == "stop_and_go") != F.col("intrusive")
    if "retained_percent" in have:
        rules["retained_percent"] = F.isnan(F.col("retained_percent").cast("double")) | ~F.col("retained_percent").between(0, 100)
    for c in sorted({"requested_ns", "observed_ns"} & have):
        rules[f"empty_{c.removesuffix('_ns')}_time"] = F.col(c) <= 0
    if "cleanup_complete" in have:
        rules["cleanup_incomplete"] = ~F.col("cleanup_complete")
    if {"firmware_status", "elf_sha256", "firmware_proof"} <= have:
        proofs = F.try_element_at(F.create_map(*[x for k, v in FIRMWARE_PROOFS.items() for x in (F.lit(k), F.lit(v).cast("array<string>"))]), F.col("firmware_status"))
        proven = F.when(F.size(proofs) == 0, F.col("firmware_proof").isNull()).otherwise(F.col("elf_sha256").isNotNull() & F.array_contains(proofs, F.coalesce("firmware_proof", F.lit(""))))
        rules["firmware_proof"] = ~F.coalesce(proven, F.lit(False))
    broken = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return rows.select("session_id", F.explode(broken).alias("violation"))


def admitted(histograms: DataFrame, least_hits: int = 100, least_ns: int = 100_000_000, least_percent: float = 90.0, most_failures: int = 0) -> DataFrame:
    """Add the first reason for which a histogram gives no quantities, or null."""
    reason = (
        F.when(~F.col("target_running"), "target_not_running").when(F.coalesce(F.col("last_sample_rate_hz"), F.lit(0)) <= 0, "sample_rate_missing").when(F.col("in_scope_hits") < least_hits, "too_few_hits")
        .when(F.col("observed_duration_ns") < least_ns, "capture_too_short").when(F.col("retained_runtime_percent") < least_percent, "runtime_not_retained").when(F.col("snoop_failures") > most_failures, "snoop_failures")
    )
    return histograms.withColumn("reason", reason)


def hottest(cells: DataFrame, n: int, *ties: str) -> DataFrame:
    """The n cells of each session with most hits; ties by the named columns."""
    order = Window.partitionBy("session_id").orderBy(F.desc("hits"), *ties)
    return cells.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def dominant_cells(samples: DataFrame, width: int, n: int = 10, inner: int = 4) -> DataFrame:
    """The fullest inner cell (then the lowest) of each of the n fullest buckets of a session."""
    keyed = samples.select("session_id", F.expr(f"address div {width} * {width}").alias("bucket"), F.expr(f"address div {inner} * {inner}").alias("cell"))
    cells = keyed.groupBy("session_id", "bucket", "cell").agg(F.count("*").alias("cell_hits"))
    own = cells.groupBy("session_id", "bucket").agg(F.sum("cell_hits").alias("hits"), F.max_by(F.struct("cell", "cell_hits"), F.struct("cell_hits", -F.col("cell"))).alias("top"))
    return hottest(own, n, "bucket").select("session_id", "bucket", "hits", F.col("top.cell").alias("cell"), F.col("top.cell_hits").alias("cell_hits"), "place")


def flat_profile(cells: DataFrame, n: int) -> DataFrame:
    """The n - 1 fullest leaves of each session, and the rest as one; hits are conserved."""
    order = Window.partitionBy("session_id").orderBy(F.desc("hits"), F.asc_nulls_last("function_id"))
    ranked = cells.withColumn("place", F.row_number().over(order)).withColumn("many", F.count("*").over(Window.partitionBy("session_id")))
    kept = (F.col("many") <= n) | (F.col("place") < n)
    label = F.when(kept, F.coalesce("function_id", F.lit("[unattributed]"))).otherwise("[other sampled PCs]")
    return ranked.groupBy("session_id", label.alias("label")).agg(F.sum("hits").alias("hits"))


def flat_layout(profile: DataFrame, width: int = 10_000) -> DataFrame:
    """Extents of a flat profile's leaves: whole shares of the row, the last leaf takes what is left of it."""
    order = Window.partitionBy("session_id").orderBy(F.desc("hits"), "label")
    whole = Window.partitionBy("session_id")
    rows = profile.withColumn("total", F.sum("hits").over(whole)).withColumn("own", F.expr(f"hits * {width} div total")).withColumn("x", F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("x", F.coalesce("x", F.lit(0))).withColumn("last", F.row_number().over(order) == F.count("*").over(whole))
    return rows.select("session_id", "label", "hits", "x", F.when(F.col("last"), width - F.col("x")).otherwise(F.col("own")).alias("w"))


def labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Each bucket with the debugger's label for exactly its bounds: label and label_hits, or nulls."""
    return buckets.join(labels.select("session_id", "start", "end", "label", F.col("hits").alias("label_hits")), ["session_id", "start", "end"], "left")


def leaves(buckets: DataFrame) -> DataFrame:
    """Flat leaves of labelled buckets: the labelled hits under their label, what is left of a bucket unattributed."""
    rest = F.col("hits") - F.coalesce("label_hits", F.lit(0))
    parts = F.array(F.struct(F.col("label").alias("function_id"), F.coalesce("label_hits", F.lit(0)).alias("hits")), F.struct(F.lit(None).cast("string").alias("function_id"), rest.alias("hits")))
    each = buckets.select("session_id", F.explode(parts).alias("p")).select("session_id", "p.*").where("hits > 0")
    return each.groupBy("session_id", "function_id").agg(F.sum("hits").alias("hits"))


def for_display(cells: DataFrame, n: int) -> DataFrame:
    """The n fullest buckets of each session, numbered by address."""
    kept = hottest(cells, n, "start")
    return kept.withColumn("row", F.row_number().over(Window.partitionBy("session_id").orderBy("start", "end")))


#: Firmware statuses under which addresses may be read as functions.
PROVEN = ("verified", "deployment_asserted")


def sampling_report(histograms: DataFrame, buckets: DataFrame, ranges: DataFrame, displayed: int = 25, kept_leaves: int = 20, **limits: float) -> dict[str, DataFrame]:
    """The parts of a report on sampled histograms, each only of the captures that may have it.

    ``histograms``: what ``admitted`` reads (``limits`` go to it) and firmware_status. ``address``: the fullest buckets of
    admitted captures; ``function`` and ``profile``: hits by function and the fullest leaves of those whose firmware
    is proven, too; ``withheld``: session_id, part and the reason why a capture lacks a part. A null status is not proven;
    buckets of captures without a histogram are in no part.
    """
    judged = admitted(histograms, **limits).select("session_id", "reason", F.coalesce(F.col("firmware_status").isin(*PROVEN), F.lit(False)).alias("proven"))
    own = buckets.join(judged.where("reason IS NULL").select("session_id"), "session_id", "left_semi")
    functions = function_heatmap(own.join(judged.where("proven").select("session_id"), "session_id", "left_semi"), ranges)
    why = F.coalesce("reason", F.when(~F.col("proven"), "firmware_not_proven"))
    lacking = F.explode(F.array(F.struct(F.lit("address").alias("part"), F.col("reason")), F.struct(F.lit("function").alias("part"), why.alias("reason")))).alias("w")
    withheld = judged.select("session_id", lacking).select("session_id", "w.*").where("reason IS NOT NULL")
    return {"address": for_display(own, displayed), "function": functions, "profile": flat_profile(functions, kept_leaves), "withheld": withheld}
