"""Operator 4: document fingerprints by a threshold-scaled sketch.

A fingerprint keeps every 5-word shingle hash below a fixed fraction of the hash range, and the least
hash always, so that no text with words has an empty one. Sketches of one fraction merge by union
(then drop all but the least above the threshold) and estimate containment between texts of very
unequal length without any fixed size. Likeness is the shared part of the smaller sketch.

Comparing each document with the next by doc_id takes one exchange of the texts. doc_id is dealt into
ranges at approximate quantiles; rows with null doc_id, which come last, are dealt by a hash of their text.
The first document of each range also goes, flagged, to the range before. A task walks its ranges in order
and holds two documents at a time.

A null text reads as empty and has an empty fingerprint; two empty fingerprints have likeness 1, an
empty and another 0. Rows that agree in doc_id follow one another by text; null doc_ids come last, by the
hash of their text. A single document is its own next. Other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import parts_for
from spanloom.llm.grams import SLICE_BYTES, members, mix, shingle_sets, words

SHINGLE, FRACTION = 5, 4
#: Text of a range, and the most ranges in powers of SIDE; beyond them ranges grow, which a task walks with
#: two documents at a time.
RANGE_BYTES, SIDE = 24 << 20, 128
_LAST = 9223372036854775807
_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def sketches(texts: list[str], shingle: int = SHINGLE, fraction: int = FRACTION) -> list[np.ndarray]:
    """Sorted retained hashes of each text."""
    owner, g = shingle_sets(words(pa.array(texts, pa.large_string()), lower=True), shingle)
    g = mix(g, 23)
    order = np.lexsort((g, owner))
    owner, g = owner[order], g[order]
    keep = g < np.uint64((1 << 64) // fraction)
    if len(owner):
        keep |= np.concatenate([[True], owner[1:] != owner[:-1]])
    owner, g = owner[keep], g[keep]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [g[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def merged(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """The sketch of the union of two shingle sets, from their sketches."""
    both = np.union1d(a, b)
    return both[(both < np.uint64((1 << 64) // fraction)) | (np.arange(len(both)) == 0)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated containment of the smaller set in the larger."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return float(members(large, small).mean())


def written_out(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def read_in(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u8")


def fingerprint(docs: DataFrame, shingle: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row, with no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            made = [s for a, b in _spans(texts) for s in sketches(texts[a:b], shingle, fraction)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) for x in texts], pa.int64()), pa.array([written_out(s) for s in made], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


def _spans(texts: list[str]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for b, x in enumerate(texts):
        if size and size + len(x) > SLICE_BYTES // 2:
            yield a, b
            a, size = b, 0
        size += len(x)
    if texts:
        yield a, len(texts)


def compare_with_next(docs: DataFrame, shingle: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see ``queries``."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.xxhash64(text)).alias("key"))
    ranged, n = _ranged(keyed)
    place = F.struct("last", "key", "text")
    heads = ranged.groupBy("range").agg(F.min(F.struct("last", "key")).alias("head"))
    heads = heads.selectExpr("head.last AS last", "head.key AS key", "range", "coalesce(lag(range) OVER (ORDER BY range), max(range) OVER ()) AS before")
    # one row a range, of which there are at most SIDE * SIDE + 2; of rows that share the key, the least text is first
    first = ranged.join(F.broadcast(heads), ["last", "key", "range"]).groupBy("before").agg(F.min(F.struct(place.alias("place"), "doc_id")).alias("first"))
    extra = first.select(F.col("before").alias("range"), F.lit(1).alias("next"), "first.place.last", "first.place.key", "first.doc_id", "first.place.text")
    rows = ranged.select("range", F.lit(0).alias("next"), "last", "key", "doc_id", "text").unionByName(extra)
    dealt = rows.repartitionByRange(n, "range").sortWithinPartitions("range", "next", "last", "key", "text")
    return dealt.select("range", "next", "doc_id", "text").mapInArrow(lambda batches: _walk(batches, shingle, fraction), _OUT)


def _ranged(keyed: DataFrame) -> tuple[DataFrame, int]:
    """Add the index of a range of keys; ranges hold about the same number of documents."""
    missing = F.col("last")
    total, absent, count = keyed.agg(F.sum(F.octet_length("text")), F.count_if(missing), F.count("*")).first()
    n = min(SIDE * SIDE, parts_for(total or 0, RANGE_BYTES))
    if not count or n == 1:
        return keyed.withColumn("range", F.lit(0)), 1
    last = round(n * absent / count)
    n -= last
    bounds = []
    if absent < count:
        marks = [i / n for i in range(1, n)]
        bounds = keyed.where(~missing).agg(F.percentile_approx("key", marks, max(10_000, 20 * n))).first()[0] if marks else []
    bounds = sorted(set(bounds))
    # two steps of at most SIDE comparisons each: the run of bounds, then the bound
    runs = [bounds[i : i + SIDE] for i in range(0, len(bounds), SIDE)]

    def passed(limits: Column) -> Column:
        return F.size(F.filter(limits, lambda b: b <= F.col("key")))

    if runs:
        run = F.greatest(passed(F.lit([r[0] for r in runs])) - 1, F.lit(0))
        number = run * SIDE + passed(F.get(F.lit([r + [_LAST] * (SIDE - len(r)) for r in runs]), run))
    else:
        number = F.lit(0)
    number = F.least(number, F.lit(len(bounds)))  # the padding is no bound
    spread = F.lit(len(bounds) + 1) + F.floor((F.shiftright("key", 32) + F.lit(1 << 31)) * F.lit(max(last, 1)) / F.lit(float(1 << 32)))
    return keyed.withColumn("range", F.when(missing, spread).otherwise(number).cast("int")), len(bounds) + 1 + max(last, 1)


def _walk(batches: Iterator[pa.RecordBatch], shingle: int, fraction: int) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order, each with the text that follows it."""

    def pairs() -> Iterator[tuple]:
        last = None
        for batch in batches:
            for span, flag, doc_id, text in zip(*(batch[c].to_pylist() for c in ("range", "next", "doc_id", "text")), strict=True):
                if last is not None and last[0] == span and not last[1]:
                    yield last[2], last[3], text
                if last is None or last[0] != span or not last[1]:
                    last = (span, flag, doc_id, text)

    held, size = [], 0
    for pair in pairs():
        held.append(pair)
        size += len(pair[1])
        if size >= SLICE_BYTES // 4 or len(held) >= 4096:
            yield _judge(held, shingle, fraction)
            held, size = [], 0
    if held:
        yield _judge(held, shingle, fraction)


def _judge(held: list[tuple], shingle: int, fraction: int) -> pa.RecordBatch:
    texts = [x[1] for x in held]
    nexts = [x[2] for x in held]
    edited = []
    for text, after in zip(texts, nexts, strict=True):
        k = len(text) // 4
        edited.append(text[: len(text) - k] + after[:k])
    own, other = sketches(texts, shingle, fraction), sketches(edited, shingle, fraction)
    following = [own[i + 1] if i + 1 < len(texts) and after is texts[i + 1] else sketches([after], shingle, fraction)[0] for i, after in enumerate(nexts)]
    columns = [
        pa.array([x[0] for x in held], pa.int64()),
        pa.array([len(x) for x in texts], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
        pa.array([written_out(s) for s in own], pa.string()),
        pa.array([written_out(s) for s in other], pa.string()),
        pa.array(map(likeness, own, other), pa.float64()),
        pa.array(map(likeness, own, following), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _OUT.split(", ")])
