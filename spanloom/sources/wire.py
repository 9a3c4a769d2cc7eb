"""Binary records of the embedded writer: files to plain columns, then to observations.

A record is a 32-byte little-endian header and a payload, so where one starts is known only from the one before. A file is
still read by many tasks, in three steps. Each block is walked from every place near its start that looks like a header
(``steps``: where the walk leaves the block, and after how many records). Only that many places can be entered from the block
before, as a payload has a greatest size; they are few, and walks that meet go on as one. Then the blocks of a file are
linked from its front (``entries``), and each is read from the one place where it is really entered. A payload that looks like
records is thus never taken for them. Everything after the split into records is columns.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.ordering import lost, unwrapped

#: The format's mark and version, its one flag, the kinds from 1 on, exact payload sizes.
MARK, VERSION, DROPPED = b"T3PF", 1, 1
KINDS = ("Instant", "SpanBegin", "SpanEnd", "Counter", "AsyncBegin", "AsyncEnd", "TraceGap")
EXACT = {"Counter": 8, "AsyncEnd": 8, "TraceGap": 4}
HEADER = struct.Struct("<4sBBHHHIQII")
_SCHEMA = "session_id string, source_id string, ord bigint, kind string, flags int, sequence bigint, ticks decimal(20,0), wire_context bigint, wire_event bigint, payload binary, bad string"
_ARROW = pa.schema([("session_id", pa.string()), ("source_id", pa.string()), ("ord", pa.int64()), ("kind", pa.string()), ("flags", pa.int32()), ("sequence", pa.int64()), ("ticks", pa.decimal128(20, 0)), ("wire_context", pa.int64()), ("wire_event", pa.int64()), ("payload", pa.binary()), ("bad", pa.string())])
#: Records of one file that are passed on at once.
BATCH = 10_000
#: Whole numbers beyond this lose precision as doubles.
EXACT_DOUBLE = 1 << 53


def read_records(spark: SparkSession, path: str, most_payload: int = 4096, block: int = 64 << 20) -> DataFrame:
    """Records of ``path/session_id=.../<source>.bin``; a bad record carries ``bad`` and ends its file.

    Files are read in blocks of ``block`` bytes by as many tasks, where pyarrow can open them at a place; on other
    file systems whole, one a task. Empty files have no records.
    """
    block = max(block, HEADER.size + most_payload + 1)  # no record spans a whole block
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select("path", "length", F.regexp_extract("path", r"session_id=([^/]+)", 1).alias("session_id"), F.regexp_extract("path", r"([^/]+?)(\.[^/.]*)?$", 1).alias("source_id"), "content")
    opened = F.regexp_extract("path", r"^([A-Za-z0-9+.-]+):", 1).isin(*OPENED)
    listed = named.where(opened & (F.col("length") > 0)).select("path", "length", "session_id", "source_id")
    whole = named.where(~opened).select("session_id", "source_id", "content")
    blocks = listed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block).cast("bigint"))))
    several = blocks.where(F.col("length") > block)
    # blocks are dealt apart, as the listing itself may be one task; into a fixed number, as rows that are only places look like too few for many
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    walked = several.select("path", "length", "at").repartition(tasks, "path", "at").mapInArrow(lambda batches: _steps(batches, most_payload, block), STEPS)
    linked = walked.groupBy("path").applyInPandas(lambda found: entries(found, block), "path string, at bigint, entry bigint, ord bigint")
    firsts = blocks.where(F.col("length") <= block).select("path", "length", "session_id", "source_id", "at", F.lit(0).cast("bigint").alias("entry"), F.lit(0).cast("bigint").alias("ord"))
    due = firsts.unionByName(several.join(linked, ["path", "at"]).select(*firsts.columns))
    return due.repartition(tasks, "path", "at").mapInArrow(lambda batches: _read(batches, most_payload, block), _SCHEMA).unionByName(whole.mapInArrow(lambda batches: _read_whole(batches, most_payload), _SCHEMA))


#: File systems that pyarrow opens; any other is read by Spark alone.
OPENED = ("file", "hdfs", "viewfs", "s3", "s3a", "s3n", "gs", "gcs")
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
STEPS = "path string, at bigint, entry bigint, leaves bigint, n bigint"


def _bytes(path: str, at: int, n: int) -> bytes:
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        system, name = pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        authority, _, inner = rest.removeprefix("//").partition("/")
        system, root = pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{authority}/")
        name = f"{root.rstrip('/')}/{inner}"
    with system.open_input_file(name) as file:
        return file.read_at(n, at)


def _steps(batches: Iterator[pa.RecordBatch], most_payload: int, block: int) -> Iterator[pa.RecordBatch]:
    """For each place where a block may be entered: where its walk leaves the block (null: the file ends there) and its records."""
    reach = HEADER.size + most_payload
    for batch in batches:
        for path, at in zip(batch["path"].to_pylist(), batch["at"].to_pylist(), strict=True):
            # a block without any such place has a row, too, so that no file is lost
            found = steps(_bytes(path, at, block + reach), block, 1 if at == 0 else reach, most_payload) or [(-1, None, 0)]
            entry, leaves, n = ([x[k] for x in found] for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([at] * len(found), pa.int64()), pa.array([at + x if x >= 0 else x for x in entry], pa.int64()), pa.array([None if x is None else at + x for x in leaves], pa.int64()), pa.array(n, pa.int64())], [c.split()[0] for c in STEPS.split(", ")])


def steps(data: bytes, block: int, reach: int, most_payload: int) -> list[tuple[int, int | None, int]]:
    """(entry, where its walk leaves the first ``block`` bytes, records) of each good header among the first ``reach`` bytes.

    ``data`` goes beyond the block by one record. A walk that meets an earlier one takes over its end.
    """
    known: dict[int, tuple[int | None, int]] = {}  # place -> where its walk leaves, records from there
    found = []
    entry = data.find(MARK, 0, reach + len(MARK) - 1)
    while entry >= 0:
        places, at = [], entry
        while at is not None and at < block and at not in known:
            places.append(at)
            at = follows(data, at, most_payload)
        end, n = known[at] if at in known else (at, 0)
        for place in reversed(places):
            n += 1
            known[place] = end, n
        if follows(data, entry, most_payload) is not None or entry == 0:
            found.append((entry, *known[entry]))
        entry = data.find(MARK, entry + 1, reach + len(MARK) - 1)
    return found


def entries(found: pd.DataFrame, block: int) -> pd.DataFrame:
    """Where each block of one file is entered, and the number of its first record, from the front on."""
    known = {(at, entry): (None if pd.isna(leaves) else int(leaves), int(n)) for at, entry, leaves, n in found[["at", "entry", "leaves", "n"]].itertuples(index=False)}
    rows, place, ord_ = [], 0, 0
    while place is not None:
        at = place // block * block
        rows.append((found["path"].iloc[0], at, place, ord_))
        # a place that no walk started from has a bad record, which ends the file
        place, n = known.get((at, place), (None, 0))
        ord_ += n
    return pd.DataFrame(rows, columns=["path", "at", "entry", "ord"])


def _read(batches: Iterator[pa.RecordBatch], most_payload: int, block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in batch.to_pylist():
            end = one["at"] + block
            data = _bytes(one["path"], one["entry"], end - one["entry"] + HEADER.size + most_payload)
            yield from _batched(records(data, most_payload, one["ord"], end - one["entry"]), one["session_id"], one["source_id"])


def _read_whole(batches: Iterator[pa.RecordBatch], most_payload: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in batch.to_pylist():
            yield from _batched(records(one["content"] or b"", most_payload), one["session_id"], one["source_id"])


def _batched(found: Iterator[dict], session: str, source: str) -> Iterator[pa.RecordBatch]:
    rows = []
    for row in found:
        rows.append({"session_id": session, "source_id": source, **row})
        if len(rows) == BATCH:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, _ARROW)


def judged(data: bytes, at: int, most_payload: int) -> tuple[dict, int]:
    """The record at a place, with ``bad`` if it breaks a rule, and where it ends."""
    if len(data) - at < HEADER.size:
        return {"bad": "truncated_header"}, len(data)
    mark, version, number, flags, size, reserved, sequence, ticks, context, event = HEADER.unpack_from(data, at)
    kind = KINDS[number - 1] if 1 <= number <= len(KINDS) else None
    payload = data[at + HEADER.size : at + HEADER.size + size]
    reasons = [
        ("invalid_mark", mark != MARK), ("unsupported_version", version != VERSION), ("unknown_kind", kind is None), ("unsupported_flags", bool(flags & ~DROPPED)), ("reserved_field", reserved != 0),
        ("payload_too_large", size > most_payload), ("payload_length", size != EXACT.get(kind, size) or (kind == "AsyncBegin" and size < 8)), ("truncated_payload", len(payload) < size),
    ]
    bad = next((name for name, is_bad in reasons if is_bad), None)
    return {"kind": kind, "flags": flags, "sequence": sequence, "ticks": ticks, "wire_context": context, "wire_event": event, "payload": payload, "bad": bad}, at + HEADER.size + size


def follows(data: bytes, at: int, most_payload: int) -> int | None:
    """Where the record after the one at a place starts, or nothing: it is bad, or the data end with it."""
    row, end = judged(data, at, most_payload)
    return None if row["bad"] or end >= len(data) else end


def records(data: bytes, most_payload: int, first: int = 0, until: int | None = None) -> Iterator[dict]:
    """Records that start before ``until``, up to the end or the first bad one, numbered from ``first``."""
    at, n = 0, first
    while at < (len(data) if until is None else min(len(data), until)):
        row, at = judged(data, at, most_payload)
        yield {"ord": n, **row}
        if row["bad"]:
            return
        n += 1


def wire_observations(found: DataFrame, contexts: DataFrame | None = None, counters: DataFrame | None = None) -> DataFrame:
    """Observations with expanded sequence, ``missing`` records before each, and ``violation``.

    ``contexts``: wire_context, context_id. ``counters``: wire_event, counter_id, required_context (null: any).
    Where a mapping is given, what it lacks is a violation; so is a name that is not UTF-8, which reads as null. Ticks become times by ``ordering.session_time``.
    """
    rows = found.where("bad IS NULL").withColumn("modulus", F.lit(1 << 32))
    rows = unwrapped(lost(rows), "sequence", "modulus", "source_seq").drop("modulus")
    kind = F.col("kind")
    named = F.when(kind.isin("Instant", "SpanBegin", "SpanEnd"), F.col("payload")).when(kind == "AsyncBegin", F.expr("substring(payload, 9)")).cast("string")
    context: Column = F.concat(F.lit("context:"), F.col("wire_context").cast("string"))
    counter: Column = F.concat(F.lit("counter:"), F.col("wire_event").cast("string"))
    broken = F.when(F.col("regressed"), "sequence_out_of_order").when(~F.is_valid_utf8(named), "name_not_utf8")
    if contexts is not None:
        rows = rows.join(contexts, "wire_context", "left")
        context = F.col("context_id")
        broken = broken.when(context.isNull() & (kind != "TraceGap"), "unmapped_context")
    if counters is not None:
        rows = rows.join(counters, "wire_event", "left")
        counter = F.col("counter_id")
        broken = broken.when((kind == "Counter") & counter.isNull(), "unmapped_counter").when((kind == "Counter") & (F.col("required_context") != F.col("wire_context")), "counter_context_mismatch")
    number = F.conv(F.hex(_reversed()), 16, -10).cast("bigint")
    value = F.when(kind == "Counter", number)
    broken = broken.when((kind == "Counter") & (F.abs(value) > EXACT_DOUBLE), "counter_precision_loss")
    event = F.concat(F.lit("event:"), F.col("wire_event").cast("string"))
    correlation = F.concat(F.lit("correlation:"), F.conv(F.hex(_reversed()), 16, 10))
    return rows.select(
        "session_id", "source_id", "ord", "source_seq", "missing", "ticks", kind.alias("type"), F.when(kind == "TraceGap", "inferred").otherwise("exact").alias("quality"), F.when(kind != "TraceGap", context).alias("context_id"),
        F.when(kind.isin("SpanBegin", "SpanEnd"), event).alias("span_id"), F.when(kind.isin("AsyncBegin", "AsyncEnd"), correlation).alias("correlation_id"), F.when(kind == "Counter", counter).alias("counter_id"), value.cast("double").alias("value"),
        F.try_validate_utf8(named).alias("name"),
        F.when(kind == "TraceGap", F.concat(F.lit("reported_drop:"), F.conv(F.hex(_reversed()), 16, 10))).alias("reason"), broken.alias("violation"),
    )


def _reversed() -> Column:
    """The first eight payload bytes (or fewer), last byte first."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(F.expr("substring(payload, 1, 8)")), F.lit("(..)"), F.lit(1))), ""))
