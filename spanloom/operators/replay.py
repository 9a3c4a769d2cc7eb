"""Exact replay of captures: activations, interrupts, bracketed spans, CPU time and health facts in one pass.

Rows are dealt by session_id and sorted by ``ord`` once; each task reads its sorted rows in chunks of many captures and
``passes`` finds everything in a chunk by whole columns. A capture longer than a chunk goes on in the next, of which
only what is open is held, so neither a session nor a task is ever held whole.

The result has one row for each thing found; ``kind`` tells which:

* ``span``: an activation, when it ends. Active time is what its execution context was credited meanwhile.
* ``interrupt``: an interrupt activation, when it ends, with its nesting depth, the activation it interrupted and
  the scheduled context below.
* ``sync``, ``async``: a span between its begin and end marks.
* ``cpu``: the time credited to one context of a session.
* ``session``, only if asked for: ``ord`` says how many rows a capture has; a long one has several such rows.
* ``fact``: a health fact, by ``code``. A gap whose reason names a fault, and metadata that tell of one, give a fact of
  that code, too.

Null ``core_id`` means no core (allowed for marks, counters and gaps). Missing optional columns read as null. Rows of
one ``ord`` keep an arbitrary order; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.scalar import metadata_code, severe_gap
from spanloom.operators.passes import Replay, State

INPUT = ("ord", "source_id", "source_seq", "quality", "type", "ts_ns", "core_id", "context_id", "function_id", "frame_id", "prev_context_id", "next_context_id", "interrupt_id", "activation_id", "span_id", "correlation_id", "name", "duration_ns", "told")
OUTPUT = (
    "kind string, session_id string, ord bigint, parent_ord bigint, source_id string, source_seq_start bigint, source_seq_end bigint, core_id bigint, context_id string, ctx_kind string, function_id string, depth bigint, start_ns bigint, end_ns bigint, "
    "elapsed_ns bigint, active_ns bigint, self_ns bigint, preempted_ns bigint, incomplete boolean, quality string, code string"
)
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in OUTPUT.split(", ")])
#: Every kind of row.
KINDS = ("span", "interrupt", "sync", "async", "cpu", "session", "fact")
#: Rows of a chunk, at least.
CHUNK = 100_000


def told(observations: DataFrame) -> Column:
    """The health code that a row names itself: a gap by its reason, metadata by key and value."""
    have = set(observations.columns)
    out = F.lit(None).cast("string")
    if {"key", "value"} <= have:
        out = F.when(F.col("type") == "Metadata", metadata_code(F.col("key"), F.col("value"))).otherwise(out)
    if "reason" in have:
        out = F.when(F.col("type") == "TraceGap", severe_gap(F.col("reason"))).otherwise(out)
    return out


def replay(observations: DataFrame, switches: bool = True, chunk: int = CHUNK, kinds: tuple[str, ...] | None = None, dealt: bool = False, ordered: bool = False) -> DataFrame:
    """Everything found in the captures, or rows of some ``kinds``; without ``switches`` every call of another task reschedules its core.

    ``dealt``: each capture is in one partition already, as after a ``repartition`` by session_id, so rows stay where they are.
    ``ordered``: its rows also follow one another there, by ``ord`` and with none of another capture between them, so nothing is sorted.
    """
    tells = "reason" in observations.columns or {"key", "value"} <= set(observations.columns)
    rows = observations.withColumn("told", told(observations)) if tells and "told" not in observations.columns else observations
    given = [c for c in INPUT if c in rows.columns]
    rows = rows.select("session_id", *given)
    if not ordered:
        rows = (rows if dealt else rows.repartition("session_id")).sortWithinPartitions("session_id", "ord")
    return rows.mapInArrow(lambda batches: replayed(batches, switches, chunk, kinds), OUTPUT)


def replayed(batches: Iterator[pa.RecordBatch], switches: bool = True, chunk: int = CHUNK, kinds: tuple[str, ...] | None = None) -> Iterator[pa.RecordBatch]:
    """What is found in sorted rows, chunk by chunk."""
    held: list[pa.RecordBatch] = []
    size, state, open_session = 0, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < chunk:
            continue
        table = pa.Table.from_batches(held)
        # the last capture waits for its other rows, unless it fills the chunk
        sessions = table["session_id"].combine_chunks()
        last = sessions[-1]
        cut = _first(sessions, last)
        if state is not None and (cut or last.as_py() != open_session):
            first = _end(sessions, open_session)
            yield from rows_out(Replay(table.slice(0, first), switches, state, True, name=open_session), kinds)
            table, cut, state = table.slice(first), cut - first, None
        if cut:
            yield from rows_out(Replay(table.slice(0, cut), switches, None, True), kinds)
            table = table.slice(cut)
        if table.num_rows >= chunk or state is not None:
            done = Replay(table, switches, state, False)
            yield from rows_out(done, kinds)
            state, open_session, table = done.state, last.as_py(), table.slice(table.num_rows)
        held, size = table.to_batches(), table.num_rows
    table = pa.Table.from_batches(held) if held else None
    if state is not None:
        first = _end(table["session_id"].combine_chunks(), open_session) if table is not None else 0
        own = table.slice(0, first) if table is not None else pa.table({"session_id": pa.array([], pa.string()), "type": pa.array([], pa.string())})
        yield from rows_out(Replay(own, switches, state, True, name=open_session), kinds)
        table = table.slice(first) if table is not None else None
    if table is not None and table.num_rows:
        yield from rows_out(Replay(table, switches, None, True), kinds)


def _first(sessions: pa.Array, session: pa.Scalar) -> int:
    """Where the run of the last session starts."""
    return len(sessions) - _run(sessions.take(pa.array(np.arange(len(sessions))[::-1])), session.as_py())


def _end(sessions: pa.Array, session: str | None) -> int:
    """How many rows at the start are of a session."""
    return _run(sessions, session)


def _run(sessions: pa.Array, session: str | None) -> int:
    same = sessions.is_null() if session is None else pa.compute.equal(sessions, session).fill_null(False)
    other = np.flatnonzero(~same.to_numpy(zero_copy_only=False))
    return int(other[0]) if len(other) else len(sessions)


def rows_out(done: Replay, kinds: tuple[str, ...] | None = None) -> Iterator[pa.RecordBatch]:
    if kinds is not None and "session" in kinds:
        done.count_rows()
    for found in done.out:
        if kinds is not None and found["kind"][0].as_py() not in kinds:
            continue
        n = len(found["kind"])
        columns = [pa.nulls(n, f.type) if found.get(f.name) is None else found[f.name].cast(f.type) for f in ARROW]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=ARROW)


def sessions(found: DataFrame) -> DataFrame:
    """The captures of a replay that tells them, and how many observations each has."""
    return found.where("kind = 'session'").groupBy("session_id").agg(F.sum("ord").alias("observations"))


def spans(found: DataFrame) -> DataFrame:
    """The activations of a replay."""
    own = ("session_id", "ord", "parent_ord", "source_id", "source_seq_start", "source_seq_end", "core_id", "context_id", "ctx_kind", "function_id", "depth", "start_ns", "end_ns", "elapsed_ns", "active_ns", "self_ns", "preempted_ns", "incomplete", "quality")
    return found.where("kind = 'span'").select(*own)


def interrupts(found: DataFrame) -> DataFrame:
    """Interrupt activations: nesting depth, the activation each interrupted, and the task below."""
    return found.where("kind = 'interrupt'").select("session_id", "ord", "core_id", F.col("context_id").alias("interrupt_id"), "depth", F.col("parent_ord").alias("interrupted_ord"), F.col("function_id").alias("preempted_context_id"), "start_ns", "end_ns", "elapsed_ns", "active_ns", "incomplete")


def brackets(found: DataFrame) -> DataFrame:
    """Spans between begin and end marks, on one core's context (sync) or across cores (async)."""
    return found.where("kind IN ('sync', 'async')").select("session_id", "ord", F.col("kind").alias("form"), "source_id", "core_id", "context_id", F.col("function_id").alias("name"), "start_ns", "end_ns", "elapsed_ns", "incomplete")


def facts(found: DataFrame) -> DataFrame:
    """Health facts of a replay."""
    return found.where("kind = 'fact'").select("session_id", "ord", "code", "source_id", F.col("source_seq_start").alias("source_seq"), "core_id", "context_id", "function_id", "start_ns", "end_ns")


def contexts(found: DataFrame) -> DataFrame:
    """CPU time of each context; all activations of an interrupt fold together."""
    return found.where("kind = 'cpu'").select("session_id", "context_id", F.col("ctx_kind").alias("kind"), "active_ns").where("active_ns > 0")
