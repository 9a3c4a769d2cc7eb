"""Operator 10: token ids in binary files, frequency-ranked and byte-aligned.

File format (little-endian), one file for a run of documents in ascending doc_id order:

    magic "SLTK", u32 version, u64 documents, u64 how many of the last have no doc_id, u64 ids, u64 data bytes
    i64 doc_id of each document (0 where it has none), u32 ids of each document
    control bytes: two bits an id, four ids a byte, lowest bits first: 1 to 3 data bytes
    data bytes: the frequency rank of each id, little-endian, in as many bytes as its control says

``ranks.bin`` beside the files lists the ids by falling frequency in the whole corpus, so the 256 most
frequent take one byte. Decoding looks a control byte up in a 256-row table of four lengths; offsets
are its running sum, and ranks become ids through the list. No bit is read one at a time.

How it runs: texts are dealt into ranges of (doc_id, hash of the text), so that rows of one doc_id need not share
a task, and tokenized once, in order; ids go to a table in the shared folder, in two bytes each where they fit, and
beside them what each slice counted of each id. These counts, summed by id (a row an id of the vocabulary), rank the
ids; each task then encodes the part of the table that it reads into files of bounded size. A file is written under
a name of its own and renamed, so a repeated task leaves the same file. Files are opened through ``pyarrow.fs``, hence any URI it knows; a path
without a scheme is on Spark's default file system.

Null and empty texts are their end id alone. Rows that agree in doc_id are kept, side by side. Null doc_ids come
last. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import new_path, parts_for, text_bytes
from spanloom.llm.tokens import encoded, vocabulary_path

MAGIC, VERSION = b"SLTK", 2
HEADER = np.dtype([("magic", "S4"), ("version", "<u4"), ("documents", "<u8"), ("absent", "<u8"), ("ids", "<u8"), ("data", "<u8")])
#: Ids in a file (one longer document fills its own), and bytes of text in a range of documents.
FILE_IDS, RANGE_BYTES = 2_000_000, 16 << 20
_INDEX = "file string, range int, first long, documents bigint, ids bigint"
#: Ranges whose files one task numbers.
RANGES_A_TASK = 4096
#: Data bytes of the four ids of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8)


def encode_file(doc_ids: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, absent: int = 0) -> bytes:
    """One file of documents given as ranks, one after another; the last ``absent`` have no doc_id."""
    n = len(ranks)
    lengths = (ranks >= 1 << 8).astype(np.uint8)
    if wide := bool(n and int(ranks.max()) >= 1 << 16):
        lengths += ranks >= 1 << 16
    lengths += 1
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    data = np.empty(int(ends[-1]) if n else 0, np.uint8)
    data[starts] = ranks.astype(np.uint8)
    longer = np.flatnonzero(lengths > 1)
    data[starts[longer] + 1] = (ranks[longer] >> np.uint32(8)).astype(np.uint8)
    if wide:
        longer = np.flatnonzero(lengths > 2)
        data[starts[longer] + 2] = (ranks[longer] >> np.uint32(16)).astype(np.uint8)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = lengths
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    header = np.array([(MAGIC, VERSION, len(doc_ids), absent, n, len(data))], HEADER)
    return b"".join([header.tobytes(), doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def decode_file(content: bytes, by_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc_ids, sizes and ids of one file, and how many of its last documents have no doc_id."""
    head = np.frombuffer(content, HEADER, 1)[0]
    if head["magic"] != MAGIC or head["version"] != VERSION:
        raise ValueError("not a token file of this version")
    docs, n = int(head["documents"]), int(head["ids"])
    at = HEADER.itemsize
    doc_ids = np.frombuffer(content, "<i8", docs, at)
    sizes = np.frombuffer(content, "<u4", docs, at + 8 * docs)
    at += 12 * docs
    control = np.frombuffer(content, np.uint8, -(-n // 4), at)
    data = np.frombuffer(content, np.uint8, int(head["data"]), at + len(control))
    lengths = LENGTHS[control].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = data[starts].astype(np.uint32)
    for k in (1, 2):
        longer = np.flatnonzero(lengths > k)
        if len(longer):
            ranks[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return doc_ids, sizes, by_rank[ranks], int(head["absent"])


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Write token files under ``path``; return their index: file, first_doc_id, documents, ids."""
    spark = docs.sparkSession
    path = qualified(spark, path)
    ids = _ids_table(docs, end_id, vocabulary_path(tokenizer), new_path(spark, "ids"))
    counted = ids.where("counts IS NOT NULL").select("counts").mapInArrow(_counts, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = np.array([r["id"] for r in counted.orderBy(F.desc("n"), "id").collect()], dtype="<u4")  # a row an id of the vocabulary
    _put(f"{path}/ranks.bin", ranked.tobytes())
    where, folder = fs.FileSystem.from_uri(f"{path}/files")
    where.create_dir(folder)
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 0, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    sent = spark.sparkContext.broadcast(rank_of)
    index = ids.select("range", "seq", "missing", "key", "width", "ids").mapInArrow(lambda batches: _encode(batches, path, sent.value), _INDEX)
    index.write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Files in order, with the ids of all files before each.

    Sums have two levels, within runs of ranges and over the runs, so that no task has all files.
    """
    index = spark.read.schema(_INDEX).parquet(f"{qualified(spark, path)}/index").withColumn("run", F.expr(f"range div {RANGES_A_TASK}"))
    runs = index.groupBy("run").agg(F.sum("ids").alias("own")).selectExpr("run", "sum(own) OVER (ORDER BY run) - own AS earlier")
    inside = index.withColumn("inside", F.expr("sum(ids) OVER (PARTITION BY run ORDER BY range, first) - ids"))
    return inside.join(runs, "run").withColumn("before", F.col("earlier") + F.col("inside")).drop("run", "earlier", "inside")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of each document, from the files alone."""
    path = qualified(spark, path)
    by_rank = spark.sparkContext.broadcast(np.frombuffer(_get(f"{path}/ranks.bin"), "<u4"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(f"{path}/files").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    placed = files.join(read_index(spark, path).select("file", "before"), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, before in zip(batch["content"], batch["before"].to_pylist(), strict=True):
                doc_ids, sizes, ids, absent = decode_file(content.as_buffer().to_pybytes(), by_rank.value)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes.astype(np.int64))
                starts = ends - sizes
                missing = np.arange(len(sizes)) >= len(sizes) - absent
                for a in range(0, len(sizes), 2000):
                    b = min(a + 2000, len(sizes))
                    parts = [raw[4 * s : 4 * e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    columns = [pa.array(doc_ids[a:b], mask=missing[a:b]), pa.array(starts[a:b] + before), pa.array(sizes[a:b].astype(np.int64)), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return placed.select("content", "before").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def _ids_table(docs: DataFrame, end_id: int, tokenizer: str, path: str) -> DataFrame:
    """(range, seq, missing, key, width, ids, counts): ids of each text, sorted within ranges; ids of two bytes where a slice's fit.

    ``counts`` is there once a slice: its ids and how often each occurs.
    """
    ranges = parts_for(text_bytes(docs), RANGE_BYTES)
    keyed = docs.select(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("key"), "text", F.xxhash64("text").alias("tie"))
    dealt = keyed.repartitionByRange(ranges, "missing", "key", "tie").sortWithinPartitions("missing", "key", "tie", "text").select("missing", "key", "text", F.spark_partition_id().alias("range"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch, i, j, ids, sizes in encoded(batches, tokenizer, end_id):
            n = j - i
            kind = "<u2" if int(ids.max()) < 1 << 16 else "<u4"
            width = int(kind[-1])
            ends = np.concatenate([[0], np.cumsum(sizes * width)]).astype(np.int64)
            packed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
            all_counts = np.bincount(ids)
            some = np.flatnonzero(all_counts)
            counts = np.stack([some, all_counts[some]]).astype("<i8").tobytes()
            columns = [batch["range"].slice(i, n), pa.array(np.arange(seq, seq + n)), batch["missing"].slice(i, n), batch["key"].slice(i, n), pa.array(np.full(n, width, np.int32)), packed, pa.array([counts] + [None] * (n - 1), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["range", "seq", "missing", "key", "width", "ids", "counts"])
            seq += n

    schema = "range int, seq bigint, missing boolean, key bigint, width int, ids binary, counts binary"
    dealt.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _unpack(width: int, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if width == 2 else "<u4").astype(np.uint32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1, np.int64)
    for batch in batches:
        for packed in batch["counts"]:
            some, n = np.frombuffer(packed.as_buffer(), "<i8").reshape(2, -1)
            if len(some) and some[-1] >= len(counts):
                counts = np.concatenate([counts, np.zeros(int(some[-1]) + 1 - len(counts), np.int64)])
            counts[some] += n
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["id", "n"])


def _encode(batches: Iterator[pa.RecordBatch], path: str, rank_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Files from rows that follow one another in one range; a file takes whole documents."""
    held: list[tuple[np.ndarray, ...]] = []
    part, first, after, size = -1, 0, 0, 0

    def flush() -> pa.RecordBatch:
        name = f"{part:06d}-{first:012d}.tok"
        missing, keys, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        _put(f"{path}/files/{name}", encode_file(keys, sizes, rank_of[ids], int(missing.sum())))
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([size], pa.int64())], ["file", "range", "first", "documents", "ids"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        parts, seqs, width = (batch[c].to_numpy() for c in ("range", "seq", "width"))
        sizes = pc.binary_length(batch["ids"]).to_numpy().astype(np.int64) // width
        # runs of rows of one range, one after another, of one width, and of at most a file's ids together
        group = np.cumsum(sizes) // FILE_IDS
        new = (parts[1:] != parts[:-1]) | (seqs[1:] != seqs[:-1] + 1) | (width[1:] != width[:-1]) | (group[1:] != group[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ids = _unpack(int(width[a]), b"".join(batch["ids"].slice(a, b - a).to_pylist()))
            if held and (part != parts[a] or after != seqs[a] or size + len(ids) > FILE_IDS):
                yield flush()
                held, size = [], 0
            if not held:
                part, first = int(parts[a]), int(seqs[a])
            held.append((batch["missing"].slice(a, b - a).to_numpy(zero_copy_only=False), batch["key"].slice(a, b - a).to_numpy(), sizes[a:b], ids))
            after, size = int(seqs[b - 1]) + 1, size + len(ids)
    if held:
        yield flush()


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI, by Spark's default file system where it names none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _put(uri: str, content: bytes) -> None:
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0])
    part = f"{path}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(part) as out:
        out.write(content)
    where.move(part, path)


def _get(uri: str) -> bytes:
    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_stream(path) as source:
        return source.read()
