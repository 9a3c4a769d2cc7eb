"""Operator 9: best-fit packing planned on the histogram of lengths.

Texts are tokenized once, in place, and cut into pieces of at most ``capacity`` tokens; the first
piece takes what does not divide. Piece sizes are counted: at most ``capacity`` numbers, whatever the
corpus. ``plan`` runs best-fit-decreasing on these counts. All sequences with the same room left are
interchangeable, so one step places as many pieces as fit into all of them at once; the steps number
at most one a (length, room) pair. A step says: pieces of this length with ranks from..to go to
sequences from..to at this offset.

Pieces take their planned slots by rank within their length. The rank has two levels, a row number
within (block, length) and the running count of the blocks before, so that no length needs to be in
one task however common it is. Steps are cut at multiples of ``RANK_BLOCK`` ranks and joined on
(length, rank block), so a piece meets the few steps of its own rank block.

A null or empty text is its end id alone. Repeated rows are packed as they are; doc_id may be null.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import parts_for, written
from spanloom.llm.tokens import encoded, vocabulary_path

CAPACITY = 2048
RANK_BLOCK = 4096
#: Pieces of one block of ranks.
PIECES_A_BLOCK = 50_000


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    pieces = written(token_pieces(docs, capacity, end_id, vocabulary_path(tokenizer)), "pieces")
    counts = pieces.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}
    return place(pieces, plan(histogram, capacity))


def token_pieces(docs: DataFrame, capacity: int, end_id: int, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, ids, sizes in encoded(batches, path, end_id):
            many = -(-sizes // capacity)
            owner = np.repeat(np.arange(j - i), many)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            head = (sizes - (many - 1) * capacity)[owner]  # the first piece takes what does not divide
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            length = np.where(piece == 0, head, capacity)
            low = (np.cumsum(sizes) - sizes)[owner] + start
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(low.tolist(), (low + length).tolist(), strict=True)]
            doc_id = batch["doc_id"].slice(i, j - i).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit-decreasing over counts: steps (length, first rank, pieces, first sequence, offset).

    ``room`` holds runs of sequences by the room they have left; the smallest room that fits is
    filled first. The runs are as many as the steps, whatever the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    steps, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        rooms = [r for r in room if r >= length and room[r]]
        heapq.heapify(rooms)
        while left and rooms:
            r = rooms[0]
            if not room[r]:
                heapq.heappop(rooms)
                continue
            first, n = room[r].pop()
            take = min(n, left)
            if take < n:
                room[r].append((first + take, n - take))
            steps.append((length, rank, take, first, capacity - r))
            if r - length >= length and not room[r - length]:
                heapq.heappush(rooms, r - length)
            room[r - length].append((first, take))
            rank, left = rank + take, left - take
        each = capacity // length
        while left:
            # new sequences take as many of this length as fit, then one more takes the rest
            whole = left // each
            n, fit = (whole, each) if whole else (1, left)
            for k in range(fit):
                steps.append((length, rank, n, opened, k * length))
                rank += n
            room[capacity - fit * length].append((opened, n))
            opened += n
            left -= n * fit
    return steps


def place(pieces: DataFrame, steps: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Give each piece its planned (sequence_id, offset) by its rank within its length."""
    spark = pieces.sparkSession
    blocks = parts_for(pieces.count(), PIECES_A_BLOCK)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(blocks)).cast("int"))
    before = dealt.groupBy("length", "block").agg(F.count("*").alias("n")).select("length", "block", F.expr("sum(n) OVER (PARTITION BY length ORDER BY block) - n").alias("before"))
    own = dealt.withColumn("own", F.expr("row_number() OVER (PARTITION BY length, block ORDER BY doc_id, piece, start, ids_crc32) - 1"))
    ranked = own.join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("own")).withColumn("rank_block", F.expr(f"rank div {RANK_BLOCK}"))
    names = ["length", "from_rank", "n", "from_sequence", "offset"]
    table = pa.table({c: pa.array([s[i] for s in steps], pa.int64()) for i, c in enumerate(names)})
    planned = spark.createDataFrame(table).withColumn("rank_block", F.explode(F.expr(f"sequence(from_rank div {RANK_BLOCK}, (from_rank + n - 1) div {RANK_BLOCK})")))
    placed = ranked.join(planned, ["length", "rank_block"]).where("rank >= from_rank AND rank < from_rank + n")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("from_sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset")
