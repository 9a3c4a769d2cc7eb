"""Binary records, good and bad."""

import random
import struct

import pandas as pd
import pytest

from pyspark.sql import functions as F

from spanloom.sources import wire


def record(kind, sequence, payload=b"", ticks=0, context=1, event=9, flags=0, mark=b"T3PF"):
    return struct.pack("<4sBBHHHIQII", mark, 1, kind, flags, len(payload), 0, sequence, ticks, context, event) + payload


def read(spark, folder, data):
    (folder / "session_id=s").mkdir()
    (folder / "session_id=s" / "core0.bin").write_bytes(data)
    return wire.read_records(spark, str(folder))


def test_every_kind(spark, tmp_path):
    data = b"".join(
        [
            record(1, 2**32 - 2, "naïve".encode(), ticks=5), record(2, 2**32 - 1, b"load"), record(3, 0), record(4, 3, struct.pack("<q", -7)), record(5, 4, struct.pack("<Q", 2**63 + 1) + b"dma"),
            record(6, 5, struct.pack("<Q", 2**63 + 1)), record(7, 6, struct.pack("<I", 12)), record(4, 7, struct.pack("<q", 2**53 + 1)),
        ]
    )
    got = wire.wire_observations(read(spark, tmp_path, data)).orderBy("ord").collect()
    assert [r["type"] for r in got] == ["Instant", "SpanBegin", "SpanEnd", "Counter", "AsyncBegin", "AsyncEnd", "TraceGap", "Counter"]
    assert [r["source_seq"] for r in got] == [2**32 - 2, 2**32 - 1, 2**32, 2**32 + 3, 2**32 + 4, 2**32 + 5, 2**32 + 6, 2**32 + 7]
    assert [r["missing"] for r in got] == [0, 0, 0, 2, 0, 0, 0, 0]
    assert (got[0]["name"], got[0]["context_id"], got[1]["span_id"], got[3]["value"], got[3]["counter_id"]) == ("naïve", "context:1", "event:9", -7.0, "counter:9")
    assert (got[4]["correlation_id"], got[4]["name"], got[5]["correlation_id"], got[6]["reason"]) == (f"correlation:{2**63 + 1}", "dma", f"correlation:{2**63 + 1}", "reported_drop:12")
    assert [r["violation"] for r in got] == [None] * 7 + ["counter_precision_loss"]


def test_bad_records_end_a_file(spark, tmp_path):
    cases = {"invalid_mark": record(1, 2, mark=b"XXXX"), "unknown_kind": record(8, 2), "unsupported_flags": record(1, 2, flags=2), "payload_length": record(4, 2, b"abc"), "truncated_payload": record(1, 2, b"abc")[:-1], "truncated_header": b"T3PF"}
    for name, data in cases.items():
        folder = tmp_path / name
        folder.mkdir()
        assert [r["bad"] for r in read(spark, folder, record(1, 1) + data).orderBy("ord").collect()] == [None, name]


def test_mappings(spark, tmp_path):
    data = record(4, 1, struct.pack("<q", 1)) + record(4, 2, struct.pack("<q", 1), context=2) + record(4, 3, struct.pack("<q", 1), event=8) + record(1, 4, context=3)
    contexts = spark.createDataFrame([(1, "task-a"), (2, "task-b")], "wire_context bigint, context_id string")
    counters = spark.createDataFrame([(9, "heap", 1)], "wire_event bigint, counter_id string, required_context bigint")
    got = wire.wire_observations(read(spark, tmp_path, data), contexts, counters).orderBy("ord").collect()
    assert [r["violation"] for r in got] == [None, "counter_context_mismatch", "unmapped_counter", "unmapped_context"]
    assert (got[0]["counter_id"], got[0]["context_id"]) == ("heap", "task-a")


def messy(r, n):
    """Records whose payloads hold marks, whole records and halves of them."""
    out = []
    for k in range(n):
        inner = r.choice([b"", b"T3PF", b"x" * r.randrange(50), record(1, 5, b"in" * r.randrange(9)), record(4, 7, struct.pack("<q", 3))[r.randrange(20) :], record(2, 9, b"q" * 60)[:40]])
        out.append(record(r.choice([1, 2, 3]), k, inner, ticks=k))
    return b"".join(out)


@pytest.mark.parametrize("seed", range(8))
def test_any_block_size_gives_the_same(seed):
    """Blocks walked alone and linked give the records of a reading from the front, also where a bad record ends it."""
    r = random.Random(seed)
    data = messy(r, 120)
    if seed % 2:
        at = r.randrange(len(data))
        data = data[:at] + r.choice([b"", b"T3PF", b"\0" * 40, record(9, 1)]) + data[at + r.randrange(40) :]
    most = 120
    due = list(wire.records(data, most))
    reach = wire.HEADER.size + most
    for block in (reach + 1, 300, 1000, len(data) - 1):
        walks = [("f", at, at + e, None if leaves is None else at + leaves, n) for at in range(0, len(data), block) for e, leaves, n in wire.steps(data[at : at + block + reach], block, 1 if at == 0 else reach, most)]
        found = pd.DataFrame(walks or [("f", 0, -1, None, 0)], columns=["path", "at", "entry", "leaves", "n"])
        got = []
        for _, at, entry, first in wire.entries(found, block).itertuples(index=False):
            got += wire.records(data[entry : at + block + reach], most, first, at + block - entry)
        assert got == due


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    data = messy(random.Random(5), 900) + b"T3P"
    (tmp_path / "session_id=s t").mkdir()
    (tmp_path / "session_id=s t" / "core 0.bin").write_bytes(data)
    (tmp_path / "session_id=s t" / "none.bin").write_bytes(b"")
    got = wire.read_records(spark, str(tmp_path), 120, 2000).orderBy("ord").collect()
    due = list(wire.records(data, 120))
    assert len(due) == 901 and [(x["ord"], x.get("kind"), x.get("payload"), x["bad"]) for x in due] == [(x["ord"], x["kind"], None if x["payload"] is None else bytes(x["payload"]), x["bad"]) for x in got]
    assert {(x["session_id"], x["source_id"]) for x in got} == {("s t", "core 0")}


def test_a_large_file_without_any_record_is_told(spark, tmp_path):
    assert [(r["ord"], r["bad"]) for r in [*read(spark, tmp_path, b"\1" * 9000).collect(), *wire.read_records(spark, str(tmp_path), 120, 500).collect()]] == [(0, "invalid_mark")] * 2


def test_names_that_are_not_utf8(spark, tmp_path):
    got = wire.wire_observations(read(spark, tmp_path, record(1, 1, b"ok") + record(1, 2, b"\xff\xfe") + record(5, 3, struct.pack("<Q", 255) + b"fine"))).orderBy("ord").collect()
    assert [(r["name"], r["violation"]) for r in got] == [("ok", None), (None, "name_not_utf8"), ("fine", None)]


def test_blocks_of_a_file_are_read_by_many_tasks(spark, tmp_path):
    folder = tmp_path / "session_id=s"
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"".join(wire.HEADER.pack(b"T3PF", 1, 1, 0, 0, 0, i, i, 0, 0) for i in range(5000)))
    found = wire.read_records(spark, str(tmp_path), 256, 4096)
    assert found.where("bad IS NULL").count() == 5000
    assert found.select(F.spark_partition_id()).distinct().count() > 1
