"""Sampled call stacks: folding, the prefix trie, and the layout of flame-graph rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def folded(samples: DataFrame) -> DataFrame:
    """Samples of each root-to-leaf path; ``frames`` of the input run from the leaf to the root."""
    return samples.groupBy("session_id", "termination", F.reverse("frames").alias("path")).agg(F.count("*").alias("samples"))


def trie(paths: DataFrame) -> DataFrame:
    """Samples of every prefix of every path: the nodes of the flame graph, the root row left out."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))
    each = paths.where(F.size("path") > 0).select("session_id", "termination", F.explode(prefixes).alias("path"), "samples")
    return each.groupBy("session_id", "termination", "path").agg(F.sum("samples").alias("samples")).withColumn("depth", F.size("path"))


def top_nodes(nodes: DataFrame, n: int = 128) -> DataFrame:
    """The n fullest nodes of each session. A child never holds more than its parent, so parents stay."""
    order = Window.partitionBy("session_id").orderBy(F.desc("samples"), "depth", "termination", "path")
    return nodes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def layout(nodes: DataFrame, n: int = 128, width: int = 10_000, most_depth: int = 64) -> DataFrame:
    """Horizontal extents of a flame graph: terminations in row 0, the n fullest nodes above, the rest of each parent as one.

    Children share their parent's extent by running sums of samples, fullest first, in whole units; so a child's extent
    depends on its parent's. A session has at most n nodes and as many rests, which one task places.
    """
    shown = nodes.where(F.col("depth") <= most_depth)
    chosen = top_nodes(shown, n).select("session_id", "termination", "path", "depth", "samples", F.lit("frame").alias("kind"))
    left = shown.join(chosen.select("session_id", "termination", "path"), ["session_id", "termination", "path"], "left_anti")
    rests = left.groupBy("session_id", "termination", F.slice("path", 1, F.col("depth") - 1).alias("path"), "depth").agg(F.sum("samples").alias("samples"), F.lit("other").alias("kind"))
    inside = rests.join(chosen.select("session_id", "termination", "path"), ["session_id", "termination", "path"], "left_semi").unionByName(rests.where("depth = 1"))
    roots = nodes.where("depth = 1").groupBy("session_id", "termination").agg(F.sum("samples").alias("samples")).select("session_id", "termination", F.array().cast("array<string>").alias("path"), F.lit(0).alias("depth"), "samples", F.lit("boundary").alias("kind"))
    rows = chosen.unionByName(inside).unionByName(roots)
    return rows.groupBy("session_id").applyInPandas(lambda g: _placed(g, width), "session_id string, termination string, kind string, path array<string>, depth int, samples bigint, x bigint, w bigint")


def _placed(rows: pd.DataFrame, width: int) -> pd.DataFrame:
    """Extents of one session's few rows, parents before children."""
    total = int(rows.loc[rows["depth"] == 0, "samples"].sum())
    extent = {(): (0, width, total)}
    used: dict[tuple, int] = {}
    out = []
    order = sorted(rows.itertuples(index=False), key=lambda r: (r.depth, -r.samples, r.kind == "other", r.termination, tuple(r.path)))
    for r in order:
        path = tuple(r.path)
        parent = () if r.depth == 0 else (r.termination, *(path if r.kind == "other" else path[:-1]))
        x, w, samples = extent[parent]
        before = used.get(parent, 0)
        used[parent] = before + int(r.samples)
        low, high = before * w // samples, used[parent] * w // samples
        if r.kind != "other":
            extent[(r.termination, *path)] = (x + low, high - low, int(r.samples))
        out.append((r.session_id, r.termination, r.kind, list(path), r.depth, r.samples, x + low, high - low))
    return pd.DataFrame(out, columns=["session_id", "termination", "kind", "path", "depth", "samples", "x", "w"])


def sample_violations(samples: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """session_id, sample_index (null: the capture) and violation: everything by which stack samples break their contract.

    ``samples``: session_id, sample_index, frames, and where known depths (of the frames, leaf first), termination and
    halt_ns. Indices count from one, each walk has frames, depths count from zero, and each halt took time.
    ``captures``: session_id, max_frames, and where known collected_samples, attempted_samples, max_samples and
    total_halt_ns. No walk is longer than allowed, one that ended for its length has that length, and counts and sums agree.
    """
    have = set(samples.columns)
    before = F.lag("sample_index").over(Window.partitionBy("session_id").orderBy("sample_index"))
    rows = samples.withColumn("before", before)
    size = F.size("frames")
    rules = {"sample_index_not_contiguous": F.col("sample_index") != F.coalesce(F.col("before") + 1, F.lit(1)), "empty_stack": size == 0, "missing_frame": F.exists("frames", lambda f: f.isNull())}
    if "depths" in have:
        rules["depth_not_contiguous"] = ~(F.coalesce(F.col("depths"), F.array().cast("array<int>")) == F.transform(F.col("frames"), lambda _, i: i.cast("int")))
    if "halt_ns" in have:
        rules["empty_halt"] = F.col("halt_ns") <= 0
    if captures is not None:
        rows = rows.join(captures.select("session_id", "max_frames"), "session_id", "left")
        rules["too_many_frames"] = size > F.col("max_frames")
        if "termination" in have:
            rules["ended_short_of_max_frames"] = (F.col("termination") == "max_frames") & (size != F.col("max_frames"))
    pick = lambda rules: F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("violation")
    out = rows.select("session_id", "sample_index", pick(rules))
    if captures is None:
        return out
    halted = F.sum("halt_ns") if "halt_ns" in have else F.lit(None).cast("bigint")
    seen = captures.join(samples.groupBy("session_id").agg(F.count("*").alias("n"), halted.alias("halted")), "session_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    told = set(captures.columns)
    whole = {"no_samples": F.col("n") == 0}
    if {"collected_samples", "attempted_samples", "max_samples"} <= told:
        whole["sample_counts"] = (F.col("collected_samples") != F.col("n")) | (F.greatest("collected_samples", "attempted_samples") > F.col("max_samples")) | (F.col("attempted_samples") < F.col("collected_samples"))
    if "total_halt_ns" in told and "halt_ns" in have:
        whole["halt_sum"] = F.coalesce("halted", F.lit(0)) != F.col("total_halt_ns")
    return out.unionByName(seen.select("session_id", F.lit(None).cast(samples.schema["sample_index"].dataType).alias("sample_index"), pick(whole)))
