"""Observations as a stream: running counters and totals, and exact replay by session state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.passes import LOW, NUMBERS, Replay, State
from spanloom.operators.replay import ARROW, INPUT, OUTPUT, rows_out, told
from spanloom.operators.traces import hotspots


def live_counters(counters: DataFrame) -> DataFrame:
    """Count, first, latest, least and greatest of each counter; for update mode."""
    return counters.groupBy("session_id", "counter_id").agg(F.count("*").alias("n"), F.min_by("value", "ord").alias("first"), F.max_by("value", "ord").alias("latest"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def live_windows(counters: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Counters by tumbling event-time window with a watermark."""
    return counters.withWatermark(time, late).groupBy("session_id", "counter_id", F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def _sent(observations: DataFrame) -> DataFrame:
    """The columns that a replay reads. Missing whole numbers are sent as the least one, as pandas would turn them all into doubles."""
    observations = observations if "told" in observations.columns else observations.withColumn("told", told(observations))
    given = [c for c in INPUT if c in observations.columns]
    return observations.select("session_id", *[F.coalesce(F.col(c).cast("bigint"), F.lit(LOW)).alias(c) if c in NUMBERS else F.col(c).cast("string") for c in given])


def _table(rows: pd.DataFrame) -> pa.Table:
    """Rows as sent, as a replay takes them."""

    def column(c: str) -> pa.Array:
        if c in NUMBERS:
            values = rows[c].to_numpy("int64")
            return pa.array(values, mask=values == LOW)
        return pa.array(rows[c], pa.string(), from_pandas=True)

    return pa.table({c: column(c) for c in rows.columns})


def _found(done: Replay) -> pd.DataFrame:
    return pa.Table.from_batches(rows_out(done), ARROW).to_pandas(integer_object_nulls=True)


def live_replay(observations: DataFrame, switches: bool = True, timeout: str = GroupStateTimeout.NoTimeout) -> DataFrame:
    """What ``replay`` finds, as it is found: activations and interrupts when they end, facts when they occur.

    The state of a session is what is open of it (``passes.State``), as bytes, so it does not grow with what is over. A
    micro-batch is sorted by ``ord`` before it is applied; what comes in a later one is applied in its turn and told of as a
    fact, never dropped (``live_ordered`` waits for it). A row of type ``CaptureEnd`` closes what is open and gives the CPU
    totals; the state goes then.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: State | None = pickle.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ord", kind="stable")
        last = rows["type"].eq("CaptureEnd")
        over = bool(last.any())
        end = int(rows.loc[last, "ts_ns"].iloc[0]) if over else None
        rows = rows[~last.cummax()]
        done = Replay(_table(rows), switches, held, over, end, key[0])
        if over:
            state.remove()
        elif len(rows):
            state.update((pickle.dumps(done.state),))
        yield _found(done)

    return _sent(observations).groupBy("session_id").applyInPandasWithState(run, OUTPUT, "capture binary", "append", timeout)


class _Reorder(StatefulProcessor):
    """Rows of one session wait until its own time is ``slack_ns`` past them, then are replayed in order.

    ``held`` has the waiting rows by bucket of time and arrival; a bucket is written when its rows arrive and removed when
    they are replayed, so what is written of it grows with arrivals alone. ``open`` is what is open of the capture; ``seen``
    the highest time, the number of arrivals, whether the end came and its time, and when rows came last.
    """

    def __init__(self, slack_ns: int, patience_ms: int | None, switches: bool) -> None:
        self.slack, self.patience, self.switches = slack_ns, patience_ms, switches
        self.width = max(slack_ns, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "bucket bigint, arrival bigint", "first bigint, rows binary")
        self.open = handle.getValueState("open", "capture binary")
        self.seen = handle.getValueState("seen", "highest bigint, arrivals bigint, ended boolean, end_ns bigint, came_ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  named by Spark
        highest, arrivals, ended, end, _ = self._seen()
        for batch in rows:
            last = batch["type"].eq("CaptureEnd")
            if last.any() and not ended:
                ended, end = True, int(batch.loc[last, "ts_ns"].iloc[0])
            batch = batch[~last]
            if len(batch):
                highest = max(highest, int(batch["ts_ns"].max()))
                arrivals += 1
                self._hold(batch, arrivals)
        now = timerValues.getCurrentProcessingTimeInMs() if self.patience is not None else 0
        self.seen.update((highest, arrivals, ended, end, now))
        if self.patience is None and ended:
            yield self._close(key, end)
            return
        if self.patience is not None:
            self.handle.registerTimer(now + self.patience)
        yield from self._replay(key, self._ripe(highest - self.slack))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.seen.exists():
            return
        _, _, ended, end, came = self._seen()
        if expiredTimerInfo.getExpiryTimeInMs() < came + self.patience:
            return  # rows came since
        if ended:
            yield self._close(key, end)
        else:
            yield from self._replay(key, self._ripe(None))

    def close(self) -> None:
        pass

    def _seen(self) -> tuple:
        return tuple(self.seen.get()) if self.seen.exists() else (LOW, 0, False, None, 0)

    def _hold(self, rows: pd.DataFrame, arrival: int) -> None:
        for bucket, part in rows.groupby(rows["ts_ns"] // self.width):
            self.held.updateValue((int(bucket), arrival), (int(part["ord"].min()), pickle.dumps(part)))

    def _ripe(self, bound: int | None) -> pd.DataFrame | None:
        """Take the waiting rows that lie before every row that must wait still; without a bound all are ripe."""
        waiting = [(tuple(k), v[0], v[1]) for k, v in self.held.iterator()]
        young = [first for k, first, _ in waiting if bound is not None and (k[0] + 1) * self.width - 1 > bound]
        barrier = min(young, default=None)
        taken = []
        for k, first, rows in waiting:
            if barrier is not None and first >= barrier:
                continue
            part = pickle.loads(rows)
            self.held.removeKey(k)
            if barrier is not None and len(rest := part[part["ord"] >= barrier]):
                self.held.updateValue(k, (int(rest["ord"].min()), pickle.dumps(rest)))
                part = part[part["ord"] < barrier]
            taken.append(part)
        return pd.concat(taken).sort_values("ord", kind="stable") if taken else None

    def _replay(self, key: tuple, rows: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        if rows is not None:
            done = Replay(_table(rows), self.switches, self._open(), False, None, key[0])
            self.open.update((pickle.dumps(done.state),))
            yield _found(done)

    def _close(self, key: tuple, end: int | None) -> pd.DataFrame:
        rows = self._ripe(None)
        state = self._open()
        table = _table(rows) if rows is not None else pa.table({"session_id": pa.array([], pa.string()), "type": pa.array([], pa.string())})
        for state_of in (self.held, self.open, self.seen):
            state_of.clear()
        return _found(Replay(table, self.switches, state or State(), True, end, key[0]))

    def _open(self) -> State | None:
        return pickle.loads(self.open.get()[0]) if self.open.exists() else None


def live_ordered(observations: DataFrame, slack_ns: int, patience_ms: int | None = None, switches: bool = True) -> DataFrame:
    """What ``live_replay`` finds where rows may come in any later micro-batch: they wait for each other, and are never dropped.

    A row is replayed once rows of its session that are ``slack_ns`` later have come, and all rows before it by ``ord`` with
    it; so whatever the batches, the result is that of ``replay`` as long as no row comes after one that is
    ``slack_ns`` later and follows it. A row later than that is applied out of turn and told of as a fact. With
    ``patience_ms`` (processing time), what waits is replayed when nothing came for so long, and ``CaptureEnd`` closes a
    capture only then; without, at once. Each session has a time of its own, so a slow one is not hurried by the others.
    A row that comes after its capture was closed opens a capture anew. The Spark session needs the RocksDB state store.
    """
    mode = "None" if patience_ms is None else "ProcessingTime"
    return _sent(observations).groupBy("session_id").transformWithStateInPandas(_Reorder(slack_ns, patience_ms, switches), OUTPUT, "Append", mode)


def live_hotspots(spans: DataFrame) -> DataFrame:
    """Running totals of a stream of activations that have ended; for update or complete mode."""
    return hotspots(spans)
