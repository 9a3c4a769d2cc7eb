"""Canonical observation files: a header, then dictionary entries, then observations, one JSON record a line.

A file is one session. The first bad line ends its file: it is kept with its reason, what follows is not. A text that
repeats a member at any depth is bad, as is a member that its type does not have.

A file is read in as many splits as it is large, and no line is shuffled. ``_summaries`` reads each split once, in order,
and tells a few numbers of each block of a file: its lines, its first bad one, and of each source the first and last
number and time and the first line that goes back. Windows over these rows number the blocks' lines and find where each file
ends; the lines are then read again and meet their block's row, which is broadcast if Spark finds the table small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.scalar import metadata_code, reader_fault_code, severe_gap, strict_value
from spanloom.functions.tables import kept
from spanloom.sources.files import MEMBERS, OBSERVATION

#: Members of the header and of each kind of dictionary entry.
HEADER = ["schema", "session_id", "encoding", "time_unit", "time_origin", "properties"]
ENTRIES = {
    "DefineContext": ["type", "id", "kind", "name", "core_id", "priority"],
    "DefineFunction": ["type", "id", "name", "module", "address", "file", "line"],
    "DefineCounter": ["type", "id", "name", "unit", "description", "semantic", "subject"],
}
_COMMON = ["type", "source_id", "source_seq", "quality", "ts_ns"]
_ALLOWED = ENTRIES | {t: [*_COMMON, *m] for t, m in MEMBERS.items()}
_LAST = 2**31 - 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its block and a number that rises within it, and what it holds."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = rows.withColumn("o", F.from_json("value", OBSERVATION))
    return rows.withColumns({"type": F.col("o.type"), "entry": F.coalesce(F.col("o.type").isin(*ENTRIES), F.lit(False))})


def _faults(most_bytes: int) -> tuple[Column, Column, Column]:
    """What is wrong with a line by itself: as a text, as a header, as anything else."""
    kind, keys = F.col("type"), F.json_object_keys("value")
    allowed = F.try_element_at(F.create_map(*[x for t, m in _ALLOWED.items() for x in (F.lit(t), F.lit(m))]), kind)
    part = lambda name: F.get_json_object("value", f"$.{name}")

    def extra(known: Column) -> Column:
        return F.size(F.array_except(keys, known)) > 0

    text = F.when(F.octet_length("value") > most_bytes, "line_too_long").when(~strict_value(F.col("value")), F.when(F.trim("value").endswith("}"), "malformed_json").otherwise("truncated_json"))
    head = F.when(kind.isNotNull() | extra(F.lit(HEADER)) | part("session_id").isNull() | (F.coalesce(part("encoding"), F.lit("")) != "ndjson") | part("schema").isNull(), "bad_header")
    body = (
        F.when(allowed.isNull(), "unknown_type").when(extra(allowed), "unknown_member").when(F.col("entry") & (part("id").isNull() | part("name").isNull()), "bad_entry")
        .when(~F.col("entry") & (F.col("o.source_id").isNull() | F.col("o.source_seq").isNull() | F.col("o.ts_ns").isNull()), "malformed_record")
    )
    return text, head, body


_SUMMARY = "file string, block bigint, source_id string, first bigint, n bigint, bad bigint, entry bigint, observed bigint, late bigint, first_seq bigint, first_ts bigint, top_seq bigint, top_ts bigint, back bigint"
_NONE = np.iinfo(np.int64).max


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block (source_id null) and for each source of a block; places are values of ``at``.

    Of a block: its first line and how many there are, its first bad line, its first entry, its first observation, and the
    first entry after that. Of a source of a block: its first line, the first and highest number and time, and the
    first line that goes back.
    """
    blocks: dict[tuple, list[int]] = {}
    sources: dict[tuple, list[int]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch["at"].to_numpy()
        file = batch["file"].dictionary_encode()
        block = batch["block"].to_numpy()
        code = file.indices.to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])]))
        entry = batch["entry"].to_numpy(zero_copy_only=False)
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
            key = (file.dictionary[int(code[low])].as_py(), int(block[low]))
            new = key not in blocks
            own = blocks.setdefault(key, [int(at[low]), 0, _NONE, _NONE, _NONE, _NONE])
            span = slice(low, high)
            faulty = batch["body_fault"].slice(low, high - low).is_valid().to_numpy(zero_copy_only=False)
            is_entry, place = entry[span], at[span]
            body = np.ones(high - low, bool)
            if new and key[1] == 0:
                faulty = faulty.copy()
                faulty[0], body[0] = batch["head_fault"][low].is_valid, False
            own[1] += high - low
            for k, hit in ((2, faulty), (3, body & is_entry), (4, body & ~is_entry)):
                if own[k] == _NONE and hit.any():
                    own[k] = int(place[hit.argmax()])
            late = body & is_entry & (place > own[4])
            if own[5] == _NONE and late.any():
                own[5] = int(place[late.argmax()])
            good = np.flatnonzero(body & ~is_entry) + low
            names = batch["source_id"].take(pa.array(good)).dictionary_encode()
            which = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            numbers = batch["source_seq"].take(pa.array(good)).fill_null(-1).to_numpy(zero_copy_only=False)
            times = batch["ts_ns"].take(pa.array(good)).fill_null(-1).to_numpy(zero_copy_only=False)
            places = at[good]
            for k, name in enumerate(names.dictionary.to_pylist()):
                mine = which == k
                seq, ts, where = numbers[mine], times[mine], places[mine]
                held = sources.get((*key, name))
                before = (held[3], held[4]) if held else (np.iinfo(np.int64).min, np.iinfo(np.int64).min)
                back = (seq <= np.concatenate([[before[0]], seq[:-1]])) & (np.arange(len(seq)) > (-1 if held else 0)) | (ts < np.concatenate([[before[1]], ts[:-1]]))
                first_back = int(where[back.argmax()]) if back.any() else _NONE
                if held is None:
                    sources[(*key, name)] = [int(where[0]), int(seq[0]), int(ts[0]), int(seq.max()), int(ts.max()), first_back]
                else:
                    held[3], held[4], held[5] = max(held[3], int(seq.max())), max(held[4], int(ts.max())), min(held[5], first_back)
    rows = [(f, b, None, *v, None, None, None, None, None) for (f, b), v in blocks.items()] + [(f, b, s, v[0], None, None, None, None, None, *v[1:]) for (f, b, s), v in sources.items()]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in _SUMMARY.split(", ")]
    columns = [pa.array([None if x == _NONE else x for x in c], t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SUMMARY.split(", ")])


def records(spark: SparkSession, path: str, most_bytes: int = 1 << 20) -> DataFrame:
    """Every line up to the first bad one of its file: session_id, file, line, role, type, value, o, bad."""
    rows = _lines(spark, path)
    text, head_fault, body_fault = _faults(most_bytes)
    narrow = rows.withColumn("text_fault", text).select("file", "block", "at", "entry", F.coalesce("text_fault", head_fault).alias("head_fault"), F.coalesce("text_fault", body_fault).alias("body_fault"), "o.source_id", "o.source_seq", "o.ts_ns")
    told = kept(narrow.mapInArrow(_summaries, _SUMMARY), "line-summaries")
    along = Window.partitionBy("file").orderBy("block")
    blocks = told.where("n IS NOT NULL").withColumns({"before": F.sum("n").over(along) - F.col("n"), "told": F.coalesce(F.count("observed").over(along.rowsBetween(Window.unboundedPreceding, -1)) > 0, F.lit(False))})
    line = lambda at: F.col("before") + F.col(at) - F.col("first") + 1
    blocks = blocks.select("file", "block", "first", "before", line("bad").alias("bad"), line("observed").alias("observed"), F.when(F.col("told"), line("entry")).otherwise(line("late")).alias("late"))
    blocks = kept(blocks, "line-blocks")
    earlier = Window.partitionBy("file", "source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = told.where("n IS NULL").withColumns({"seq_before": F.max("top_seq").over(earlier), "ts_before": F.max("top_ts").over(earlier)}).withColumnRenamed("first", "at")
    back = held.select("file", "block", F.when((F.col("first_seq") <= F.col("seq_before")) | (F.col("first_ts") < F.col("ts_before")), F.col("at")).otherwise(F.col("back")).alias("at")).where("at IS NOT NULL")
    disordered = back.join(blocks, ["file", "block"]).groupBy("file").agg(F.min(line("at")).alias("disorder"))
    files = blocks.groupBy("file").agg(F.min("bad").alias("bad_line"), F.min("observed").alias("observed_line"), F.min("late").alias("late_line")).join(disordered, "file", "left")
    files = files.withColumn("end", F.coalesce(F.least("bad_line", "late_line", "disorder"), F.lit(_LAST))).drop("bad_line", "late_line")
    plain = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    heads = plain.where("block = 0").join(blocks.where("before = 0").select("file", "block", F.col("first").alias("at")), ["file", "block", "at"])
    named = heads.select("file", F.get_json_object("value", "$.session_id").alias("session_id"))
    # all that a line needs to know, in one small row of its block
    known = kept(blocks.select("file", "block", "first", "before").join(files, "file").join(named, "file", "left"), "line-places")
    placed = rows.join(known, ["file", "block"]).withColumn("line", (F.col("before") + F.col("at") - F.col("first") + 1).cast("int"))
    head = F.col("line") == 1
    # all lines before the last are known to be good
    late = F.when(F.col("entry") & (F.col("line") > F.col("observed_line")), "dictionary_after_observation")
    bad = F.when(F.col("line") == F.col("end"), F.when(head, F.coalesce(text, head_fault)).otherwise(F.coalesce(text, body_fault, late, F.when(~F.col("entry") & (F.col("line") == F.col("disorder")), "out_of_order"))))
    return placed.where("line <= end").select("session_id", "file", "line", F.when(head, "header").when(F.col("entry"), "dictionary").otherwise("observation").alias("role"), "type", "value", "o", bad.alias("bad"))


def observations(found: DataFrame) -> DataFrame:
    """Observations of ``records``: session_id, ord, the columns of an observation, and ``told``, the fault that a row names."""
    said = F.to_json(F.try_variant_get(F.try_parse_json("value"), "$.value", "variant"))
    fault = F.when(F.col("o.type") == "TraceGap", severe_gap(F.col("o.reason"))).when(F.col("o.type") == "Metadata", metadata_code(F.col("o.key"), said))
    return found.where("role = 'observation' AND bad IS NULL").select("session_id", F.col("line").cast("bigint").alias("ord"), "o.*", fault.alias("told"))


def dictionary(found: DataFrame) -> DataFrame:
    """Dictionary entries of ``records``: session_id, kind, id, name, line and the whole definition."""
    part = lambda name: F.get_json_object("value", f"$.{name}")
    return found.where("role = 'dictionary' AND bad IS NULL").select("session_id", F.lower(F.substring("type", 7, 100)).alias("kind"), part("id").alias("id"), part("name").alias("name"), part("line").cast("bigint").alias("line"), F.col("value").alias("definition"))


def faults(found: DataFrame) -> DataFrame:
    """What ended a file early, as health facts: session_id, ord, code, reason."""
    return found.where("bad IS NOT NULL").select("session_id", F.col("line").cast("bigint").alias("ord"), reader_fault_code(F.col("bad")).alias("code"), F.col("bad").alias("reason"))


def write(rows: DataFrame, entries: DataFrame, path: str, schema: str) -> None:
    """One folder a session with its header, its entries (session_id, definition) and its observations in order.

    A session whose sources do not advance ends the job.
    """
    by_source = Window.partitionBy("session_id", "source_id").orderBy("ord")
    stuck = (F.col("source_seq") <= F.lag("source_seq").over(by_source)) | (F.col("ts_ns") < F.lag("ts_ns").over(by_source))
    checked = rows.withColumn("stuck", F.coalesce(stuck, F.lit(False)))
    members = [c for c in rows.columns if c not in ("session_id", "ord", "bad", "told")]
    record = F.when(F.col("stuck"), F.raise_error(F.concat(F.lit("out of order in "), "session_id"))).otherwise(F.to_json(F.struct(*members)))
    body = checked.select("session_id", F.lit(2).alias("part"), "ord", record.alias("value"))
    heads = rows.select("session_id").distinct().select("session_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("ord"), F.to_json(F.struct(F.lit(schema).alias("schema"), "session_id", F.lit("ndjson").alias("encoding"), F.lit("ns").alias("time_unit"))).alias("value"))
    words = entries.select("session_id", F.lit(1).alias("part"), F.xxhash64("definition").alias("ord"), F.col("definition").alias("value"))
    whole = heads.unionByName(words).unionByName(body).repartition("session_id").sortWithinPartitions("session_id", "part", "ord")
    whole.select("session_id", "value").write.partitionBy("session_id").text(path)
