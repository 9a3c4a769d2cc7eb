"""Operator 1: substring dedup by fixed-block anchors.

A text repeats another where 13 consecutive words are equal. Any 13 words hold a whole block of 7
words that starts at a multiple of 7 in their own text, so it is enough to index the non-overlapping
blocks of every text and to probe them with every rolling window of 7 words. Hits are extended: the
13-word windows around a hit are compared whole, and the windows that have an earlier source merge
into maximal repeats, whose words are removed.

How it runs. Texts are dealt once into *batches* by a hash of doc_id and text; that exchange is reused by the
three passes over the text. A pass ships hashes, not texts, to hash *buckets*. Hashes are packed per
(batch, bucket), after the batch has merged its own equal ones, so a passage that a third of all
documents share reaches its bucket once a batch:

1. ``_probes``: rolling 7-word hashes with a flag for block starts; a bucket answers which of them
   occur twice and start a block somewhere (anchors). 30 bits within a bucket of bounded size keep
   false anchors at a constant rate; the next step removes them.
2. ``_windows``: 64-bit hashes of the 13-word windows that hold an anchor, with the batch's smallest
   doc_id; a bucket answers which have a smaller doc_id in another batch.
3. ``_apply``: windows with an earlier source, from the answer or from the own batch, are merged and
   their words dropped.

Empty and null texts have no words; equal doc_ids (repeated rows) are no earlier than one another; a
null doc_id comes after all others. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import parts_for, text_bytes
from spanloom.llm.grams import grams, members, mix, text_slices, words

WINDOW = 13
BLOCK = 7
#: Text of a batch, and text whose hashes one bucket takes, at any size of the input. A packed row holds at
#: least one hash, so there are never more rows than hashes.
BATCH_BYTES, BUCKET_BYTES = 16 << 20, 8 << 20
_LAST = np.iinfo(np.int64).max


def substring_dedup(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    block = (window + 1) // 2
    total = text_bytes(docs)
    n_batches, n_buckets = parts_for(total, BATCH_BYTES), parts_for(total, BUCKET_BYTES)
    texts = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)).cast("int").alias("batch"))

    probes = texts.groupBy("batch").applyInArrow(lambda t: _probes(t, block, n_buckets), "batch int, bucket int, keys binary")
    anchors = probes.groupBy("bucket").applyInArrow(_anchors, "batch int, bucket int, keys binary")
    windows = (
        texts.groupBy("batch")
        .cogroup(anchors.groupBy("batch"))
        .applyInArrow(lambda t, a: _windows(t, a, window, block, n_buckets), "batch int, bucket int, keys binary, docs binary")
    )
    earlier = windows.groupBy("bucket").applyInArrow(_earlier, "batch int, keys binary")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text
    return texts.groupBy("batch").cogroup(earlier.groupBy("batch")).applyInArrow(lambda t, e: _apply(t, e, window, keep_text), schema)


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)


def _codes(g: np.ndarray, n_buckets: int) -> np.ndarray:
    """bucket << 30 | 30 bits of the hash; the bucket comes from other bits of a second mix."""
    return (mix(g, 3) % np.uint64(n_buckets) << np.uint64(30)) | (g >> np.uint64(34))


def _packed(batch: int, codes: np.ndarray, keys: np.ndarray, shift: int) -> pa.Table:
    """A row for each bucket among the sorted codes, its keys packed."""
    bucket = (codes >> np.uint64(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    lows = np.concatenate([[0], cuts]) if len(bucket) else np.zeros(0, np.int64)
    return pa.table(
        {
            "batch": pa.array(np.full(len(lows), batch), pa.int32()),
            "bucket": pa.array(bucket[lows], pa.int32()),
            "keys": pa.array([x.tobytes() for x in np.split(keys, cuts)] if len(bucket) else [], pa.binary()),
        }
    )


def _probes(table: pa.Table, block: int, n_buckets: int) -> pa.Table:
    found = [np.zeros(0, np.uint64)]
    for _, _, texts in text_slices(table["text"]):
        w = words(texts)
        at, g = grams(w, block)
        if len(at):
            found.append((_codes(g, n_buckets) << np.uint64(1)) | (w.place[at] % block == 0))
    codes = np.sort(np.concatenate(found))
    heads = np.flatnonzero(np.concatenate([[True], (codes[1:] ^ codes[:-1]) > np.uint64(1)])) if len(codes) else np.zeros(0, np.int64)
    twice = np.diff(np.append(heads, len(codes))) > 1
    starts = np.maximum.reduceat(codes & np.uint64(1), heads) if len(heads) else np.zeros(0, np.uint64)
    codes = codes[heads] >> np.uint64(1)
    keys = ((codes & np.uint64(0x3FFFFFFF)) << np.uint64(2) | twice.astype(np.uint64) << np.uint64(1) | starts).astype(np.uint32)
    return _packed(table["batch"][0].as_py(), codes, keys, 30)


def _anchors(table: pa.Table) -> pa.Table:
    """For each batch, its keys that occur twice in all and start a block somewhere."""
    each = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
    keys = np.sort(np.concatenate(each))
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] >> 2 != keys[:-1] >> 2]))
    flags = np.bitwise_or.reduceat(keys, heads)
    twice = (np.diff(np.append(heads, len(keys))) > 1) | (flags & 2 > 0)
    hits = (keys[heads] >> 2)[twice & (flags & 1 > 0)]
    out = [x[members(hits, x)] for x in ((k >> 2) for k in each)]
    kept = [i for i, x in enumerate(out) if len(x)]
    return pa.table({"batch": table["batch"].take(kept), "bucket": table["bucket"].take(kept), "keys": pa.array([out[i].tobytes() for i in kept], pa.binary())}) if kept else table.select(["batch", "bucket", "keys"]).slice(0, 0)


def _windows(table: pa.Table, anchors: pa.Table, window: int, block: int, n_buckets: int) -> pa.Table:
    empty = pa.table({"batch": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "docs": pa.array([], pa.binary())})
    if not len(table) or not len(anchors):
        return empty
    hits = np.sort(np.concatenate([(np.uint64(b) << np.uint64(30)) | np.frombuffer(k, np.uint32).astype(np.uint64) for b, k in zip(anchors["bucket"].to_pylist(), anchors["keys"].to_pylist(), strict=True)]))
    ids = _ids(table)
    found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, _, texts in text_slices(table["text"]):
        w = words(texts)
        at, g = grams(w, block)
        anchored = np.zeros(len(w.hashes) + 1, np.int32)
        anchored[at + 1] = members(hits, _codes(g, n_buckets))
        anchored = np.cumsum(anchored)
        at, g = grams(w, window)
        some = anchored[at + window - block + 1] > anchored[at]
        found.append(g[some])
        owners.append(ids[i + w.text_of[at[some]]])
    g, owner = np.concatenate(found), np.concatenate(owners)
    g, owner = _least(g, owner)
    bucket = (mix(g, 5) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    g, owner, bucket = g[order], owner[order], bucket[order]
    out = _packed(table["batch"][0].as_py(), bucket.astype(np.uint64), g, 0)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return out.append_column("docs", pa.array([_narrow(x) for x in np.split(owner, cuts)] if len(owner) else [], pa.binary()))


def _narrow(ids: np.ndarray) -> bytes:
    """The least id, then the rest above it in 4 bytes each where they fit."""
    above = ids - ids.min()
    wide = int(above.max()) >= 1 << 32 or int(above.min()) < 0
    return ids.min().tobytes() + (ids.tobytes() if wide else above.astype(np.uint32).tobytes())


def _widen(data: bytes, n: int) -> np.ndarray:
    body = memoryview(data)[8:]
    return np.frombuffer(body, np.int64) if len(body) == 8 * n else np.frombuffer(body, np.uint32).astype(np.int64) + np.frombuffer(data, np.int64, 1)


def _least(g: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, each with its least owner."""
    if not len(g):
        return g, owner
    order = np.argsort(g, kind="stable")
    g, owner = g[order], owner[order]
    heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[heads], np.minimum.reduceat(owner, heads)


def _earlier(table: pa.Table) -> pa.Table:
    """For each batch, its windows with a smaller doc_id in another batch."""
    keys = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    docs = [_widen(x, len(k)) for x, k in zip(table["docs"].to_pylist(), keys, strict=True)]
    every, least = _least(np.concatenate(keys), np.concatenate(docs))
    out = [k[least[np.searchsorted(every, k)] < d] for k, d in zip(keys, docs, strict=True)]
    kept = [i for i, x in enumerate(out) if len(x)]
    return pa.table({"batch": pa.array([table["batch"][i].as_py() for i in kept], pa.int32()), "keys": pa.array([out[i].tobytes() for i in kept], pa.binary())})


def _apply(table: pa.Table, earlier: pa.Table, window: int, keep_text: bool) -> pa.Table:
    ids = _ids(table) if len(table) else np.zeros(0, np.int64)
    foreign = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in earlier["keys"].to_pylist()])) if len(earlier) else np.zeros(0, np.uint64)
    parts = []
    for i, j, texts in text_slices(table["text"]):
        w = words(texts)
        at, g = grams(w, window)
        parts.append((i, j, texts, w.counts, at, g, ids[i + w.text_of[at]] if len(at) else np.zeros(0, np.int64)))
    every, least = _least(np.concatenate([p[5] for p in parts]), np.concatenate([p[6] for p in parts])) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    n_words, n_removed, digests, kept_texts = [], [], [], []
    for _, _, texts, counts, at, g, owner in parts:
        gone = members(foreign, g)
        if len(g):
            gone |= least[np.searchsorted(every, g)] < owner
        cover = np.zeros(int(counts.sum()) + 1, np.int32)
        np.add.at(cover, at[gone], 1)
        np.add.at(cover, at[gone] + window, -1)
        keep = np.cumsum(cover[:-1]) == 0
        low = 0
        for text, n in zip(texts.to_pylist(), counts.tolist(), strict=True):
            mine = keep[low : low + n]
            low += n
            left = int(mine.sum())
            own = text.encode().split()
            body = b" ".join(own if left == n else compress(own, mine.tolist()))
            n_words.append(n)
            n_removed.append(n - left)
            digests.append(hashlib.sha256(body).hexdigest())
            if keep_text:
                kept_texts.append(body.decode())
    out = {"doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    return pa.table(out | ({"kept_text": pa.array(kept_texts, pa.string())} if keep_text else {}))
