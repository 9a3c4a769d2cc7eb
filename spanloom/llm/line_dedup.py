"""Operator 2: line dedup by overlapping three-line windows, with DataFrame functions only.

A line ends at a newline character. Every three consecutive lines of a text, not all of them blank,
are a window with a 128-bit hash. The first window of each hash, by (doc_id, line), stays; the lines
that a later one covers go. Windows are judged on the input, not on what is left.

Hashes of all windows are grouped once, with partial aggregation, so a window that a third of all
documents share costs a row a task. Windows that occur once never go further. Later windows meet
their first by an equi-join of two written tables, whose hot keys adaptive execution splits. Covered
lines are merged into ranges by a window over one document's hits, and the kept text is built from
the gaps between ranges, in time linear in the document.

Null and empty texts, and texts of one or two lines, have no windows and stay as they are (null stays
null). A row is known by its doc_id and a hash of its text: rows that share a doc_id, or have none, are
cleaned apart, in the order of their hashes, and rows that agree in doc_id and text are one document, of
which all copies are cleaned alike. A null doc_id comes after all others. All columns of the input are kept;
``line_dedup_lines`` and ``line_dedup_removed`` replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import fresh, written

WINDOW = 3
_LAST = 9223372036854775807


def line_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The input with ``text`` cleaned, and line_dedup_lines, line_dedup_removed: lines before, lines removed."""
    at_doc = F.coalesce("doc_id", F.lit(_LAST))
    at_row = F.xxhash64("text", F.col("doc_id").isNull())
    lines = docs.where(F.instr("text", "\n") > 0).select(at_doc.alias("at_doc"), at_row.alias("at_row"), F.split("text", "\n").alias("lines"))
    windows = lines.select("at_doc", "at_row", F.posexplode(_hashes(F.col("lines"), window)).alias("at_line", "h")).where("h IS NOT NULL").select("at_doc", "at_row", "at_line", "h.*")
    place = F.struct("at_doc", "at_row", "at_line")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "repeated-windows")
    later = windows.join(first, ["h1", "h2"]).where(place > F.col("first")).select("at_doc", "at_row", "at_line").distinct()
    key, row, own = fresh(docs, "line_dedup_doc", "line_dedup_row", "line_dedup_ranges")
    ranges = _ranges(later, window).toDF(key, row, own)
    out = docs.withColumns({key: at_doc, row: at_row}).join(ranges, [key, row], "left")
    split = F.when(F.col("text").isNotNull(), F.split("text", "\n"))
    cleaned = F.when(F.col(own).isNull(), F.col("text")).otherwise(F.array_join(_kept(split, F.col(own)), "\n"))
    removed = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.coalesce(F.aggregate(own, F.lit(0), lambda n, r: n + r["high"] - r["low"] + 1), F.lit(0)))
    added = {"line_dedup_lines": F.coalesce(F.size(split), F.lit(0)).cast("bigint"), "line_dedup_removed": removed.cast("bigint")}
    return out.select(*[cleaned.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in added], *[c.alias(n) for n, c in added.items()])


def _hashes(lines: Column, window: int) -> Column:
    """A struct of two hashes for each window; null where all its lines are blank."""

    def one(i: Column) -> Column:
        parts = [F.element_at(lines, i + k) for k in range(1, window + 1)]
        both = F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2"))
        return F.when(F.trim(F.translate(F.concat(*parts), "\t\r", "  ")) != "", both)

    return F.when(F.size(lines) >= window, F.transform(F.sequence(F.lit(0), F.size(lines) - window), one))


def _ranges(later: DataFrame, window: int) -> DataFrame:
    """at_doc, at_row and their sorted, disjoint ranges of covered lines."""
    spec = "OVER (PARTITION BY at_doc, at_row ORDER BY at_line)"
    new = later.select("*", F.expr(f"at_line > coalesce(lag(at_line) {spec} + {window}, -1)").alias("new"))
    runs = new.select("at_doc", "at_row", "at_line", F.expr(f"count_if(new) {spec}").alias("run"))
    each = runs.groupBy("at_doc", "at_row", "run").agg(F.min("at_line").alias("low"), (F.max("at_line") + window - 1).alias("high"))
    return each.groupBy("at_doc", "at_row").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("ranges"))


def _kept(lines: Column, ranges: Column) -> Column:
    """The lines outside the ranges: one slice before each range and one after the last."""

    def gap(i: Column) -> Column:
        start = F.when(i > 0, F.get(ranges, i - 1)["high"] + 1).otherwise(0)
        end = F.when(i < F.size(ranges), F.get(ranges, i)["low"]).otherwise(F.size(lines))
        return F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ranges)), gap))
