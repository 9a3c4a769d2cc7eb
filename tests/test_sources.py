"""File sources on small files."""

import pytest

from spanloom.sources import files


def test_mapped_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("t,n,e,a,zz\n5,1,sample,0x10,q\n")
    mapping = {"timestamp_ticks": "t", "source_sequence": "n", "event_type": "e", "address": "a"}
    row = files.read_mapped_csv(spark, str(tmp_path / "x.csv"), mapping, "src", ["zz"]).collect()[0]
    assert (row["type"], int(row["address"]), row["source_seq"]) == ("Sample", 16, 1)
    with pytest.raises(ValueError, match="zz is neither"):
        files.resolve_columns(["t", "n", "e", "a", "zz"], mapping, [])


def test_text_exports(spark, tmp_path):
    (tmp_path / "s.txt").write_text("-1 P:0x1000 exec 2.5us fn\n0 P:0x1004 exec 3us\n")
    got = files.read_sampling_text(spark, str(tmp_path / "s.txt")).orderBy("ord").collect()
    assert [(r["ord"], int(r["address"]), r["ts_ns"], r["symbol"]) for r in got] == [(-1, 4096, 2500, "fn"), (0, 4100, 3000, None)]
    (tmp_path / "m.map").write_text(".data 0x20000000 0x10\n .sub 0x1 0x1\n.bss 0x20000010 32\n")
    got = files.read_linker_map(spark, str(tmp_path / "m.map"), {".data": "data", ".bss": "bss"}).collect()
    assert sorted((r["name"], r["size_bytes"], r["kind"]) for r in got) == [(".bss", 32, "bss"), (".data", 16, "data")]
    (tmp_path / "u.su").write_text("a.c:1:2:f\t16\tstatic\n")
    row = files.read_stack_usage(spark, str(tmp_path / "u.su")).collect()[0]
    assert (row["function"], row["bytes"], row["ambiguous"]) == ("f", 16, False)
