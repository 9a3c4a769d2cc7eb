"""Operator 12: a Merkle manifest of a dataset, kept as aligned subtrees in van Emde Boas layout.

A leaf is the digest of a row's fields. Leaves of one language ascend by doc_id and make a tree; the
languages' roots make the tree of the dataset. Two consecutive nodes make their parent; a last one alone does too.

1. ``leaf_rows`` hashes each row where it is read; only digests travel on.
2. ``_ranked`` deals them by range of (language, doc_id, digest) and numbers them: each task counts its own rows,
   and a table with a row for each range adds what lies before. No language needs to be in one task.
3. ``subtrees`` cuts each tree into aligned subtrees of ``LEVELS`` levels. A subtree is one row: its nodes in van
   Emde Boas order, that is, the upper half of its levels first and then each lower subtree, each laid out the same
   way. The subtrees' roots are the leaves of the next round, so rounds are few (four for 10^12 rows).
4. ``proofs`` goes down again: what a subtree's root needs to reach the top is what each of its leaves needs after
   its own siblings, which come from the same addresses.

A null language is a tree of its own and comes first. Rows of one doc_id follow one another by digest, so rows
that repeat may trade places without changing a digest; a null doc_id comes first. Other columns are ignored. An
empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import parts_for, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10
#: Leaves that one task numbers.
LEAVES_A_PART = 16_384
_STEP = 33  # bytes of a step of a path: 0 no sibling, 1 sibling to the right, 2 to the left; then its digest


@dataclass
class Manifest:
    """Trees of the languages and the tree of the dataset, each as its rounds of subtrees."""

    trees: DataFrame  # tree, key (language), total
    rounds: list[DataFrame]
    top: list[DataFrame]

    def root(self) -> DataFrame:
        """One row: root (hex); none for an empty table."""
        return roots(self.top).select(F.lower(F.hex("root")).alias("root"))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """key (language), doc_id, leaf, and other: the leaf after tampering, where there is some; no exchange."""

    def said(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    def digest(**changed: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*[said(changed.get(c, F.col(c))) for c in FIELDS]), 256))

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = digest(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)
    return docs.select(F.col("lang").alias("key"), "doc_id", digest().alias("leaf"), F.when(tampered & F.col("n_chars").isNotNull(), more).alias("other"))


def manifest(docs: DataFrame, levels: int = LEVELS, leaves_a_part: int = LEAVES_A_PART) -> Manifest:
    rows = written(leaf_rows(docs).withColumn("spread", F.monotonically_increasing_id()), "leaves")
    leaves, trees = _ranked(rows, ["doc_id", "leaf", "spread"], leaves_a_part)
    rounds = subtrees(leaves.select("tree", "idx", "total", F.col("leaf").alias("node"), "doc_id", "other"), levels)
    # a language's root takes its place among the languages
    top = subtrees(roots(rounds).select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(trees.count()).cast("bigint").alias("total"), F.col("root").alias("node")), levels)
    return Manifest(trees, rounds, top)


def proofs(made: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each input row."""
    one = roots(made.top).select(F.col("tree"), F.unhex(F.lit("")).alias("upper"), F.col("root"), F.col("root").alias("subroot"))
    whole = _descended(made.top, one).mapInArrow(_paths, _PATHS)
    of_tree = written(whole.select(F.col("block").alias("tree"), "upper", "root").join(roots(made.rounds).withColumnRenamed("root", "subroot"), "tree"), "tree-paths")
    return _descended(made.rounds, of_tree).mapInArrow(_folded, _PROOFS)


# numbers


def _ranked(rows: DataFrame, order: list[str], each: int) -> tuple[DataFrame, DataFrame]:
    """The rows with tree, idx and total: the number of their key, their place within it, and its rows; and (tree, key, total)."""
    n = parts_for(rows.count(), each)
    dealt = rows.repartitionByRange(n, "key", *order).sortWithinPartitions("key", *order)
    names = {"part": "int", "chunk": "int", "own": "bigint"}
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + [f"{c} {t}" for c, t in names.items()])
    counted = written(dealt.mapInArrow(_numbered, schema), "numbered")
    chunks = written(counted.groupBy("part", "chunk").agg(F.count("*").alias("n"), F.first("key").alias("key")), "chunks")
    parts = chunks.groupBy("part").agg(F.sum("n").alias("rows"), (F.max("chunk") + 1).alias("keys"), F.min_by(F.struct("key"), "chunk").alias("head"), F.max_by(F.struct("key"), "chunk").alias("tail"))
    along = Window.orderBy("part")  # one row a range
    parts = parts.withColumn("joined", F.lag("tail").over(along).eqNullSafe(F.col("head")).cast("int"))
    new = F.col("keys") - F.col("joined")
    parts = parts.select("part", "joined", (F.sum("rows").over(along) - F.col("rows")).alias("rows_before"), (F.sum(new).over(along) - new).alias("keys_before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n")
    placed = chunks.withColumn("inside", inside).join(parts, "part").select("part", "chunk", "key", "n", (F.col("keys_before") + F.col("chunk") - F.col("joined")).alias("tree"), (F.col("rows_before") + F.col("inside")).alias("start"))
    placed = written(placed, "chunk-places")
    trees = written(placed.groupBy("tree").agg(F.first("key").alias("key"), F.sum("n").alias("total"), F.min("start").alias("first")), "trees")
    offsets = written(placed.select("part", "chunk", "tree", "start").join(trees, "tree").select("part", "chunk", "tree", "total", (F.col("start") - F.col("first")).alias("offset")), "offsets")
    return counted.join(offsets, ["part", "chunk"]).withColumn("idx", F.col("offset") + F.col("own")), trees.drop("first")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal keys of one task, and the rows of each."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, chunk, own = None, -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch["key"].dictionary_encode(null_encoding="encode")
        code = coded.indices.to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sizes = np.diff(np.append(heads, len(code)))
        first = batch["key"][0].as_py()
        follows = chunk >= 0 and first == last
        numbers = np.repeat(chunk + (not follows) + np.arange(len(heads)), sizes)
        place = np.arange(len(code)) - np.repeat(heads, sizes)
        if follows:
            place[: sizes[0]] += own
        last, chunk, own = batch["key"][-1].as_py(), int(numbers[-1]), int(place[-1]) + 1
        extra = [pa.array(np.full(len(code), part, np.int32)), pa.array(numbers.astype(np.int32)), pa.array(place.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "chunk", "own"])


# subtrees


@cache
def addresses(height: int) -> list[np.ndarray]:
    """Where the nodes of each depth of a complete binary tree lie: the upper half of the levels, then each lower subtree."""
    return [_address(depth, np.arange(1 << depth), height + 1) for depth in range(height + 1)]


def _address(depth: int, i: np.ndarray, levels: int) -> np.ndarray:
    if levels == 1:
        return np.zeros_like(i)
    upper = levels // 2
    if depth < upper:
        return _address(depth, i, upper)
    lower, below = levels - upper, depth - upper
    size = (1 << lower) - 1
    return (1 << upper) - 1 + (i >> below) * size + _address(below, i & ((1 << below) - 1), lower)


def parents(nodes: list[bytes]) -> list[bytes]:
    """The next level of a tree; digests are hex text."""
    return [hashlib.sha256(b"".join(nodes[k : k + 2])).hexdigest().encode() for k in range(0, len(nodes), 2)]


_SUBTREE = "tree bigint, block bigint, total bigint, levels int, n int, nodes binary, root binary"


def subtrees(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Rounds of subtrees of ``nodes(tree, idx, total, node)``; the first keeps the leaves' doc_id and other, if given."""
    carried = {c: f"array<{t}>" for c, t in nodes.dtypes if c in ("doc_id", "other")}
    rounds = []
    while True:
        schema = ", ".join([_SUBTREE, *[f"{c} {t}" for c, t in carried.items()]])
        keyed = nodes.withColumn("block", F.shiftright("idx", levels))
        blocks = written(keyed.groupBy("tree", "block").applyInArrow(_maker(levels, tuple(carried)), schema), "subtrees")
        rounds.append(blocks)
        above = blocks.where(F.col("total") > (1 << levels))
        if above.isEmpty():
            return rounds
        total = F.shiftright(F.col("total") + ((1 << levels) - 1), levels)
        nodes, carried = above.select("tree", F.col("block").alias("idx"), total.alias("total"), F.col("root").alias("node")), {}


def _maker(levels: int, kept: tuple[str, ...]) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _subtree(table, levels, kept)


def _subtree(table: pa.Table, levels: int, kept: tuple[str, ...]) -> pa.Table:
    table = table.take(pa.array(np.argsort(table["idx"].to_numpy(), kind="stable")))
    total = table["total"][0].as_py()
    height = min(levels, (total - 1).bit_length())
    at = addresses(height)
    nodes = np.zeros(((2 << height) - 1, 32), np.uint8)
    row = [x.hex().encode() for x in table["node"].to_pylist()]
    for depth in range(height, -1, -1):
        nodes[at[depth][: len(row)]] = np.frombuffer(bytes.fromhex(b"".join(row).decode()), np.uint8).reshape(-1, 32)
        row = parents(row) if depth else row
    out = {"tree": table["tree"][:1], "block": table["block"][:1], "total": [total], "levels": pa.array([levels], pa.int32()), "n": pa.array([table.num_rows], pa.int32()), "nodes": [nodes.tobytes()], "root": [bytes.fromhex(row[0].decode())]}
    for c in kept:
        one = table[c].combine_chunks()
        out[c] = pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one)
    return pa.table(out)


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    found = [x.where(F.expr("total <= shiftleft(1L, levels)")).select("tree", "root") for x in rounds]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def siblings(nodes: bytes, n: int, levels: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf digests of a subtree, and for each leaf the steps to the subtree's root."""
    height = min(levels, (total - 1).bit_length())
    at = addresses(height)
    cells = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    steps = np.zeros((n, height, _STEP), np.uint8)
    for up in range(height):
        i = np.arange(n) >> up
        there = (i ^ 1) < -(-n // (1 << up))
        steps[there, up, 0] = 1 + (i[there] & 1)
        steps[there, up, 1:] = cells[at[height - up][(i ^ 1)[there]]]
    return cells[at[height][:n]], steps.reshape(n, height * _STEP)


_PATHS = "tree bigint, block bigint, upper binary, root binary, subroot binary"


def _descended(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first round's subtrees, each with ``upper``, the steps from its root to the very top.

    ``tops(tree, upper, root, subroot)`` has those of the trees. A tree of one subtree is met by its number, a subtree
    of a larger one by its place.
    """
    above = None
    for blocks in reversed(rounds):
        last = F.expr("total <= shiftleft(1L, levels)")
        named = blocks.withColumnRenamed("root", "own_root")
        met = named.where(last).join(tops, "tree")
        if above is not None:
            met = met.unionByName(named.where(~last).join(above, ["tree", "block"]))
        if blocks is not rounds[0]:
            above = written(met.mapInArrow(_paths, _PATHS), "paths")
    return met


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in names), strict=True)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each leaf of each subtree: its place and its steps to the top."""
    for tree, block, total, levels, n, nodes, upper, root, subroot in _rows(batches, "tree", "block", "total", "levels", "n", "nodes", "upper", "root", "subroot"):
        _, steps = siblings(nodes, n, levels, total)
        columns = [pa.array([tree] * n, pa.int64()), pa.array((block << levels) + np.arange(n)), pa.array([x.tobytes() + upper for x in steps], pa.binary()), pa.array([root] * n, pa.binary()), pa.array([subroot] * n, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["tree", "block", "upper", "root", "subroot"])


_PROOFS = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def fold(node: bytes, steps: bytes) -> tuple[bytes, bytes]:
    """What a node becomes by its steps to the top, and the siblings on the way; digests are hex text."""
    met = []
    for k in range(0, len(steps), _STEP):
        sibling = steps[k + 1 : k + _STEP].hex().encode() if steps[k] else b""
        met.append(sibling)
        node = hashlib.sha256(sibling + node if steps[k] == 2 else node + sibling).hexdigest().encode()
    return node, b"".join(met)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _PROOFS.split(", ")]
    for total, levels, n, nodes, upper, root, subroot, doc_ids, others in _rows(batches, "total", "levels", "n", "nodes", "upper", "root", "subroot", "doc_id", "other"):
        leaves, steps = siblings(nodes, n, levels, total)
        own = [x.tobytes().hex() for x in leaves]
        ends, proof = [], []
        for leaf, other, path in zip(own, others, steps, strict=True):
            end, met = fold((other.hex() if other is not None else leaf).encode(), path.tobytes() + upper)
            ends.append(end.decode())
            proof.append(hashlib.sha256(met).hexdigest())
        top = root.hex()
        columns = [pa.array(doc_ids, pa.int64()), pa.array(own), pa.array([subroot.hex()] * n), pa.array([top] * n), pa.array(proof), pa.array(ends), pa.array([x == top for x in ends])]
        yield pa.RecordBatch.from_arrays(columns, names)
