"""Operator 11: near-duplicate documents by SimHash, compared exactly in tiles.

1. ``fingerprints`` reads every text once. Words are lower-cased (A-Z); each three-word shingle, repeats
   included, gives its XXH64, and a bit of the fingerprint is 1 where over half of the hashes have it.
2. Equal fingerprints are one node, so copies cost nothing further.
3. A node lies in the cell of the population counts of its two halves; there are at most 33 * 33. Cells are
   cut into tiles of about ``TILE`` nodes by hash. Two fingerprints within the radius have counts that
   differ by no more than the radius in all, so only tile pairs of such cells meet, each pair in one group.
4. Inside a group the nodes of either tile are ordered by the counts of their four quarters and cut into runs.
   Pairs of runs whose counts differ beyond the radius are skipped; all others are compared whole, by numpy
   exclusive-or and bit counts.
5. A group gives a star for each of its components and not its links, so that a family of m near copies costs
   m rows and not their square. The components of the stars are those of all links.

Null and empty texts have fingerprint zero and are linked like any other. Rows with one doc_id are one node:
what any of them reaches, all reach. A row with a null doc_id has the component of its fingerprint, which is
null where it reaches no doc_id, and is kept. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import written
from spanloom.llm.components import connected_components
from spanloom.llm.grams import text_slices

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Nodes of a tile and of a run.
TILE, RUN = 32_768, 256
#: Hashes whose bits are counted at once.
HASHES = 1 << 16
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE, run: int = RUN) -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 hex digits), component_id, kept."""
    made = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = near(nodes, radius, tile, run)
    same = _same_document(made)
    labels = connected_components(links if same is None else links.unionByName(same)).withColumnRenamed("node", "fp")
    reached = nodes.join(labels, "fp")
    least = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = reached.join(least, "component").select("fp", "component_id")
    placed = nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    out = made.join(placed, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed number; no exchange."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in text_slices(batch["text"]):
                fp = simhash(part, shingle)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id bigint, fp bigint")


def simhash(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of the texts (no nulls) as unsigned numbers."""
    n = len(texts)
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []

    def count() -> None:
        if held:
            sizes = np.array([len(x) for x in held])
            bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(ones, owners, np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64))
            np.add.at(total, owners, sizes)
            held.clear()
            owners.clear()

    size = 0
    for i, text in enumerate(texts.to_pylist()):
        for hashes in _hashes(text.encode(), shingle):
            held.append(hashes)
            owners.append(i)
            size += len(hashes)
            if size >= HASHES:
                count()
                size = 0
    count()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of one text, at most ``HASHES`` at a time; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest as digest

    words = text.translate(_LOWER).split()  # bytes are split at 0x20 and 0x09-0x0D
    if not words:
        return
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    for low in range(0, len(starts), HASHES):
        spans = zip(starts[low : low + HASHES].tolist(), ends[low : low + HASHES].tolist(), strict=True)
        yield np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)


def _same_document(made: DataFrame) -> DataFrame | None:
    """(a, b): fingerprints that share a doc_id; nothing where no doc_id has two."""
    mixed = made.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b")
    mixed = written(mixed.select("doc_id", "a"), "mixed")
    if mixed.isEmpty():
        return None
    return written(made.join(mixed, "doc_id").where("a != fp").select("a", F.col("fp").alias("b")).distinct(), "same-document")


def near(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, run: int = RUN) -> DataFrame:
    """(a, b): stars with the components of all pairs of ``nodes(fp)`` within the radius."""
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF))
    own = nodes.select("fp", high.cast("int").alias("high"), low.cast("int").alias("low"))
    tiles = F.ceil(F.count("*") / tile).cast("int")
    cells = F.broadcast(own.groupBy("high", "low").agg(tiles.alias("tiles")))  # at most 33 * 33 rows
    name = lambda h, l, t: (h.cast("bigint") * 33 + l) * (1 << 40) + t
    placed = own.join(cells, ["high", "low"]).select("fp", "high", "low", name(F.col("high"), F.col("low"), F.pmod(F.xxhash64("fp"), "tiles")).alias("own"))
    steps = [(h, l) for h in range(-radius, radius + 1) for l in range(abs(h) - radius, radius - abs(h) + 1)]
    step = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(l).alias("l")) for h, l in steps])).alias("step")
    other = placed.select("fp", "own", "high", "low", step).select("fp", "own", (F.col("high") + F.col("step.h")).alias("high"), (F.col("low") + F.col("step.l")).alias("low"))
    met = other.join(cells, ["high", "low"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("fp", "own", name(F.col("high"), F.col("low"), F.col("tile")).alias("that"))
    pairs = met.select(F.least("own", "that").alias("first"), F.greatest("own", "that").alias("second"), (F.col("own") <= F.col("that")).alias("is_first"), "fp")
    return pairs.groupBy("first", "second").applyInArrow(lambda t: _stars(t, radius, run), "a bigint, b bigint")


def _stars(table: pa.Table, radius: int, run: int) -> pa.Table:
    """Stars of the components that the links between two tiles make; the two may be one."""
    fp = table["fp"].to_numpy().view(np.uint64)
    first = table["is_first"].to_numpy(zero_copy_only=False)
    alone = table["first"][0] == table["second"][0]
    one = _ordered(fp if alone else fp[first], run)
    two = one if alone else _ordered(fp[~first], run)
    every = one.fp if alone else np.concatenate([one.fp, two.fp])
    shift = 0 if alone else len(one.fp)
    parent = np.arange(len(every))
    for k in range(len(one.low)):
        apart = np.maximum(np.maximum(one.low[k] - two.high, two.low - one.high[k]), 0).sum(axis=1)
        apart[: k if alone else 0] = radius + 1  # met before, the other way round
        x = one.fp[k * run : (k + 1) * run, None]
        for j in np.flatnonzero(apart <= radius).tolist():
            i, at = np.nonzero(np.bitwise_count(x ^ two.fp[None, j * run : (j + 1) * run]) <= radius)
            if len(i) > (len(x) if alone and j == k else 0):
                parent = _joined(parent, i + k * run, at + j * run + shift)
    leaf = np.flatnonzero(parent != np.arange(len(parent)))
    return pa.table({"a": every[leaf].view(np.int64), "b": every[parent[leaf]].view(np.int64)})


class _ordered:
    """Fingerprints in the order of their quarters' bit counts, and the least and greatest counts of each run."""

    def __init__(self, fp: np.ndarray, run: int) -> None:
        counts = np.stack([np.bitwise_count((fp >> np.uint64(16 * q)).astype(np.uint16)) for q in range(4)], axis=1).astype(np.int16)
        order = np.lexsort(counts.T)
        self.fp, counts = fp[order], counts[order]
        heads = np.arange(0, len(fp), run)
        self.low = np.minimum.reduceat(counts, heads) if len(fp) else counts
        self.high = np.maximum.reduceat(counts, heads) if len(fp) else counts


def _joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of all nodes after nodes i and j are joined; roots are the least nodes of their components."""
    a, b = parent[i], parent[j]
    apart = a != b
    if not apart.any():
        return parent
    for x, y in np.unique(np.stack([np.minimum(a, b)[apart], np.maximum(a, b)[apart]], axis=1), axis=0).tolist():
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        parent[max(x, y)] = min(x, y)
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up
