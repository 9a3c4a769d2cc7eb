"""The artifacts of captures: digests, sizes, provenance and pages of a listing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.tables import kept


def digests(files: DataFrame) -> DataFrame:
    """path, size and SHA-256 of files read with the ``binaryFile`` source."""
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def content_violations(artifacts: DataFrame, found: DataFrame) -> DataFrame:
    """Artifacts (artifact_id, path, size, sha256) whose file is missing or another; ``found`` comes from ``digests``."""
    real = found.select("path", F.col("size").alias("real_size"), F.col("sha256").alias("real_sha256"))
    reason = F.when(F.col("real_size").isNull(), "missing").when(F.col("size") != F.col("real_size"), "size_mismatch").when(F.lower("sha256") != F.col("real_sha256"), "digest_mismatch")
    return artifacts.join(real, "path", "left").select("artifact_id", reason.alias("violation")).where("violation IS NOT NULL")


def reference_violations(artifacts: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """artifact_id, violation and cycle: artifacts with unknown ``inputs``, and those that are among what they were made from.

    ``cycle`` is the greatest artifact of the cycles that one shares with others; what only leads to a cycle or comes
    from one is not named. More than ``most_rounds`` rounds are an error.
    """
    edges = artifacts.select("artifact_id", F.explode("inputs").alias("input")).distinct()
    known = artifacts.select(F.col("artifact_id").alias("input"))
    unknown = edges.join(known, "input", "left_anti").select("artifact_id", F.lit("unknown_input").alias("violation"), F.lit(None).cast("string").alias("cycle")).distinct()
    found = cycles(edges.join(known, "input", "left_semi").select(F.col("input").alias("a"), F.col("artifact_id").alias("b")), most_rounds)
    return unknown.unionByName(found.select(F.col("node").cast("string").alias("artifact_id"), F.lit("cycle").alias("violation"), F.col("cycle").cast("string").alias("cycle")))


def cycles(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, cycle) for the nodes of ``edges(a, b)`` that reach themselves; ``cycle`` is the greatest node of theirs.

    Rounds of four steps, each on a written table. Edges are trimmed from both ends until every node has one in and one
    out. Colours run along the edges: a node takes the greatest node that leads to it. From each node that kept its
    own colour, marks run back within the colour; what they reach is on cycles with it. Those nodes go, and the rest
    starts again. The driver sees one number a step.
    """
    rounds = 0

    def settled(step: Callable[[DataFrame], DataFrame], start: DataFrame, name: str) -> DataFrame:
        """Repeat a step until the rows that it ``moved`` are none."""
        nonlocal rounds
        now = start
        while True:
            rounds += 1
            if rounds > most_rounds:
                raise RuntimeError(f"cycles are not settled in {most_rounds} rounds")
            after = kept(step(now), name)
            now = after.drop("moved")
            if after.where("moved").isEmpty():
                return now

    def trimmed(live: DataFrame) -> DataFrame:
        ins, outs = live.select(F.col("b").alias("a"), F.lit(True).alias("fed")).distinct(), live.select(F.col("a").alias("b"), F.lit(True).alias("used")).distinct()
        both = live.join(ins, "a", "left").join(outs, "b", "left")
        good = both.withColumn("good", F.col("fed").isNotNull() & F.col("used").isNotNull())
        # edges that go are kept for one round, without their ends, so that the step can tell that it moved
        return good.select(F.when(F.col("good"), F.col("a")).alias("a"), F.when(F.col("good"), F.col("b")).alias("b"), (~F.col("good")).alias("moved"))

    live, out = kept(edges.distinct(), "edges"), None
    while True:
        live = kept(settled(lambda e: trimmed(e.where("a IS NOT NULL")), live, "trimmed").where("a IS NOT NULL"), "live")
        if live.isEmpty():
            return out if out is not None else edges.select(F.col("a").alias("node"), F.col("a").alias("cycle")).limit(0)
        nodes = live.select(F.col("a").alias("node")).distinct()

        def coloured(c: DataFrame, live: DataFrame = live) -> DataFrame:
            near = live.join(c.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("near"))
            return c.join(near, "node", "left").select("node", F.greatest("colour", "near").alias("colour"), F.coalesce(F.col("near") > F.col("colour"), F.lit(False)).alias("moved"))

        colours = settled(coloured, nodes.withColumn("colour", F.col("node")), "colours")
        inside = live.join(colours.withColumnRenamed("node", "a"), "a").join(colours.select(F.col("node").alias("b"), F.col("colour").alias("other")), "b").where("colour = other").select("a", "b")
        inside = kept(inside, "inside")

        def marked(m: DataFrame, inside: DataFrame = inside) -> DataFrame:
            back = inside.join(m.where("mark").select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), F.lit(True).alias("hit")).distinct()
            return m.join(back, "node", "left").select("node", "colour", (F.col("mark") | F.col("hit").isNotNull()).alias("mark"), (~F.col("mark") & F.col("hit").isNotNull()).alias("moved"))

        marks = settled(marked, colours.withColumn("mark", F.col("node") == F.col("colour")), "marks")
        # a node marked alone is on a cycle only if it leads to itself
        done = marks.where("mark").select("node", F.col("colour").alias("cycle"))
        size = done.groupBy("cycle").agg(F.count("*").alias("n"))
        loops = live.where("a = b").select(F.col("a").alias("node"), F.lit(True).alias("loop"))
        found = kept(done.join(size, "cycle").join(loops, "node", "left").where("n > 1 OR loop").select("node", "cycle"), "cycles")
        out = found if out is None else out.unionByName(found)
        gone = done.select("node")
        live = live.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")


def page(artifacts: DataFrame, after: str | None, limit: int) -> DataFrame:
    """The next ``limit`` artifacts by id; ``more`` tells whether others follow."""
    rest = artifacts if after is None else artifacts.where(F.col("artifact_id") > after)
    first = rest.orderBy("artifact_id").limit(limit + 1)
    many = first.agg((F.count("*") > limit).alias("more"))  # one row
    return first.orderBy("artifact_id").limit(limit).crossJoin(F.broadcast(many))
