"""Words and word n-grams of Arrow text columns as numpy hash arrays.

A word is a maximal run of bytes outside a separator set; the separators used here are ASCII, so
bytes and code points give the same words. Hashes are 64 bits wide: every byte value is weighted by
a pseudo-random number of its place in the word, the sum is mixed, and n-grams combine the word
hashes as a polynomial. Callers that need more bits combine the hash with a second mix of it only
for routing, never for equality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text handled at once by numpy, which bounds the scratch arrays; one longer text is taken alone.
SLICE_BYTES = 1 << 21

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64) of ``x`` plus a salt."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Complement of ``[^\x20\x09-\x0D]+``.
WHITE = separators((0x20, 0x20), (0x09, 0x0D))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """The words of some texts, one after another."""

    hashes: np.ndarray  # uint64, one a word
    first: np.ndarray  # int64, index of each text's first word
    counts: np.ndarray  # int64, words of each text

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def place(self) -> np.ndarray:
        """Place of each word within its text."""
        return np.arange(len(self.hashes)) - np.repeat(self.first, self.counts)


def words(column: pa.Array, white: np.ndarray = WHITE, lower: bool = False) -> Words:
    """Words of every text of a string array; null has none. ``lower`` folds A-Z."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    base = int(offsets[0])
    offsets = offsets - base
    size = int(offsets[-1])
    if not size:
        return Words(np.zeros(0, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64))
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[base : base + size]
    solid = ~white[data]
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:size]
    starts = np.flatnonzero(starts)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:size]
    lengths = np.flatnonzero(ends) + 1 - starts
    first = np.searchsorted(starts, offsets[:-1])
    counts = np.searchsorted(starts, offsets[1:]) - first
    if not len(starts):
        return Words(np.zeros(0, np.uint64), first, counts)
    inner = data[solid]
    if lower:
        inner = _LOWER[inner]
    heads = np.cumsum(lengths) - lengths
    place = np.arange(len(inner)) - np.repeat(heads, lengths)
    weights = mix(np.arange(int(lengths.max()), dtype=np.uint64), 7) | np.uint64(1)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((inner.astype(np.uint64) + np.uint64(1)) * weights[place], heads)
        return Words(mix(sums + lengths.astype(np.uint64) * _GOLD), first, counts)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and 64-bit hash of every run of ``n`` words within one text."""
    total = len(w.hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = np.zeros(total, dtype=np.uint64)
        for k in range(n):
            g = g * np.uint64(0xF1357AEA2E62A9C5) + w.hashes[k : k + total]
    ends = np.repeat(w.first + w.counts, w.counts)
    at = np.flatnonzero(np.arange(total) + n <= ends[:total])
    return at, mix(g[at], n)


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles as (text index, hash) sorted by both; a text of fewer words is one shingle."""
    at, g = grams(w, n)
    text_of = w.text_of
    owner = text_of[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        whole = np.array([_run(w.hashes[w.first[i] : w.first[i] + w.counts[i]]) for i in short], dtype=np.uint64)
        owner, g = np.concatenate([owner, short]), np.concatenate([g, whole])
    order = np.lexsort((g, owner))
    owner, g = owner[order], g[order]
    if len(g):
        new = np.ones(len(g), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (g[1:] != g[:-1])
        owner, g = owner[new], g[new]
    return owner, g


def _run(hashes: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        h = np.uint64(len(hashes))
        for x in hashes:
            h = h * np.uint64(0xF1357AEA2E62A9C5) + x
    return mix(np.array([h], dtype=np.uint64), 1001)[0]


def slices(size_of: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    ends = np.cumsum(size_of)
    i, n = 0, len(size_of)
    while i < n:
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield i, j
        i = j


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """(from row, to row, texts) of at most ``limit`` bytes each; nulls read as empty.

    After the last slice Arrow's free memory goes back to the system, as idle workers would keep it.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    for i, j in slices(np.diff(offsets.astype(np.int64)), limit):
        yield i, j, column.slice(i, j - i)
    pa.default_memory_pool().release_unused()


def members(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is among the sorted keys."""
    if not len(sorted_keys):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x
