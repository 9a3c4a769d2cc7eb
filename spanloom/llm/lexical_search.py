"""Operator 13: ranked lexical search over a length-stratified index.

1. ``term_counts`` reads every text once and keeps, of the items' terms, how often each occurs, and how many terms
   the text has in all. From that table come the corpus counts: N, L and the terms' df.
2. Documents of equal normaliser m are a stratum. ``index`` keeps it in segments of about ``POSTINGS`` postings, one
   row each: postings by term and, within a term, by falling tf, so that the impact of a tf is computed once for
   all documents that have it.
3. ``ranked`` reads segments in batches. The highest tf of each term bounds what a segment can give an item;
   an item visits segments by falling bound and stops at the first that cannot reach its tenth score. Each task
   gives at most ten documents an item, and a window picks the ten of all.

Items are the stated query set. They come in blocks of about ``ITEM_BYTES`` of text, each with an index of its own
terms; a block's vocabulary and its df are all that the driver holds.

Null and empty texts have no terms, neither count nor score. Rows of one doc_id are documents apart. Equal scores
go by ascending doc_id, nulls last. Rows of one item_id are one item of all their terms. Other columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import parts_for, written

TOP = 10
ITEM_BYTES = 4 << 20
#: Postings of a segment.
POSTINGS = 200_000
#: Sums below this are exact as doubles.
_EXACT = 1 << 53
_OUT = "item_id bigint, rank int, doc_id bigint, score bigint"


def _fold() -> bytes:
    """Bytes of terms as they are, A-Z lower-cased; all others are blanks."""
    solid = [b >= 0x80 or chr(b).isalnum() for b in range(0x100)]
    return bytes((b + 0x20 if 0x41 <= b <= 0x5A else b) if solid[b] else 0x20 for b in range(0x100))


_FOLD = _fold()


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


@dataclass
class Block:
    """Items of one block as flat arrays: the terms of item k are ``first[k]`` to ``first[k + 1]``."""

    ids: list[int | None]
    vocabulary: list[bytes]
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray


def search(docs: DataFrame, items: DataFrame, top: int = TOP, postings: int = POSTINGS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item."""
    queries = items.select("item_id", "text")
    blocks = parts_for(queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0, item_bytes)
    out = None
    for k in range(blocks):
        block = item_block(queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect())
        found = _searched(docs, block, top, postings) if block.vocabulary else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], _OUT) if out is None else out


def item_block(rows: list) -> Block:
    counts: dict[int | None, Counter] = {}
    for row in rows:
        counts.setdefault(row["item_id"], Counter()).update(terms(row["text"]))
    counts = {i: c for i, c in counts.items() if c}
    vocabulary = sorted(set().union(*counts.values()))
    number = {t: k for k, t in enumerate(vocabulary)}
    flat = [sorted((number[t], n) for t, n in c.items()) for c in counts.values()]
    sizes = [len(x) for x in flat]
    pairs = np.array([p for x in flat for p in x], np.int64).reshape(-1, 2)
    return Block(list(counts), vocabulary, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pairs[:, 0], pairs[:, 1])


def _searched(docs: DataFrame, block: Block, top: int, postings: int) -> DataFrame | None:
    counted = written(term_counts(docs, block.vocabulary), "term-counts")
    n_docs, length = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_docs:
        return None
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = np.zeros(len(block.vocabulary), np.int64)
    for term, n in df.toPandas().itertuples(index=False):  # one row a term of the block
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
    found = ranked(index(counted, n_docs, length, postings), block, weight, top)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", place).where(F.col("rank") <= top)
    names = docs.sparkSession.createDataFrame([(k, i) for k, i in enumerate(block.ids)], "item int, item_id bigint")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # the ids of one block


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (all terms), and terms and tfs of the vocabulary; no exchange."""
    number = {t: k for k, t in enumerate(vocabulary)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.__contains__
        for batch in batches:
            sizes, many, which, tfs = [], [], [], []
            for text in batch["text"].to_pylist():
                own = terms(text)
                held = Counter(filter(known, own))
                sizes.append(len(own))
                many.append(len(held))
                which += map(number.__getitem__, held)
                tfs += held.values()
            ends = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (which, tfs)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def index(counted: DataFrame, n_docs: int, length: int, postings: int = POSTINGS) -> DataFrame:
    """One row a segment: m, its documents, and runs of documents by (term, tf), tf falling."""
    m = F.expr(f"25 + CAST(CAST(75 * n AS decimal(38, 0)) * {n_docs} div {length} AS bigint)")
    rows = counted.where(F.size("terms") > 0).select(m.alias("m"), "doc_id", "terms", "tfs")
    strata = rows.groupBy("m").agg(F.ceil(F.sum(F.size("terms")) / postings).cast("int").alias("segments"))
    placed = rows.join(written(strata, "strata"), "m").withColumn("segment", F.pmod(F.xxhash64("doc_id", "terms"), "segments").cast("int")).drop("segments")
    made = placed.groupBy("m", "segment").applyInArrow(_segment, "m bigint, doc_ids array<bigint>, run_terms array<int>, run_tfs array<int>, run_ends array<int>, docs array<int>")
    return written(made, "index")


def _segment(table: pa.Table) -> pa.Table:
    lists = table["terms"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    term, tf = lists.flatten().to_numpy(), table["tfs"].combine_chunks().flatten().to_numpy()
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((doc, -tf, term))
    term, tf, doc = term[order], tf[order], doc[order]
    heads = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
    whole = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x.astype(t)))
    return pa.table({
        "m": table["m"][:1], "doc_ids": whole(table["doc_id"].combine_chunks(), None), "run_terms": whole(term[heads], np.int32),
        "run_tfs": whole(tf[heads], np.int32), "run_ends": whole(np.append(heads[1:], len(term)), np.int32), "docs": whole(doc, np.int32),
    })


class Segment:
    """A segment of the index ready for items; impacts are computed once for each tf."""

    def __init__(self, m: int, doc_ids: pa.Array, run_terms: np.ndarray, run_tfs: np.ndarray, run_ends: np.ndarray, docs: np.ndarray) -> None:
        self.doc_ids, self.docs = doc_ids, docs
        tfs, which = np.unique(run_tfs.astype(np.int64), return_inverse=True)
        impact = ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))[which]
        self.impact = np.repeat(impact, np.diff(run_ends, prepend=0))
        heads = np.flatnonzero(np.concatenate([[True], run_terms[1:] != run_terms[:-1]]))
        self.terms = run_terms[heads]
        self.highest = impact[heads]  # the first run of a term has its highest tf
        ends = np.concatenate([[0], run_ends]).astype(np.int64)
        self.first, self.last = ends[heads], ends[np.append(heads[1:], len(run_terms))]

    def scores(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Score of each document of the segment for terms and their weights."""
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        there = (self.terms[at] == term) & (weight > 0)
        spans = list(zip(self.first[at[there]].tolist(), self.last[at[there]].tolist(), strict=True))
        if not spans:
            return np.zeros(len(self.doc_ids), np.int64)
        docs = np.concatenate([self.docs[a:b] for a, b in spans])
        given = np.concatenate([self.impact[a:b] for a, b in spans]) * np.repeat(weight[there], [b - a for a, b in spans])
        if weight.sum() * 1_000_000 < _EXACT:  # an impact is below a million
            return np.bincount(docs, given, len(self.doc_ids)).astype(np.int64)
        out = np.zeros(len(self.doc_ids), np.int64)
        np.add.at(out, docs, given)
        return out

    def best(self, scores: np.ndarray, least: int, top: int) -> list[tuple]:
        """(-score, no doc_id, doc_id) of the highest scores from ``least`` on."""
        at = np.flatnonzero((scores >= least) & (scores > 0))
        if len(at) > top:
            at = at[scores[at] >= np.partition(scores[at], -top)[-top]]
        ids = self.doc_ids.take(pa.array(at)).to_pylist()
        return sorted((-s, i is None, i or 0) for s, i in zip(scores[at].tolist(), ids, strict=True))[:top]


def ranked(segments: DataFrame, block: Block, weight: np.ndarray, top: int = TOP) -> DataFrame:
    """item (its number), doc_id, score: at most ``top`` documents an item from each task, the best of all among them."""
    first, term = block.first, block.term
    value = block.times * weight[term]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in block.ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [Segment(batch["m"][k].as_py(), batch["doc_ids"][k].values, *(batch[c][k].values.to_numpy() for c in ("run_terms", "run_tfs", "run_ends", "docs"))) for k in range(batch.num_rows)]
            bounds = np.empty((len(block.ids), len(own)), np.int64)
            highest = np.zeros(len(weight), np.int64)
            for k, segment in enumerate(own):
                highest[segment.terms] = segment.highest
                bounds[:, k] = np.add.reduceat(value * highest[term], first[:-1])
                highest[segment.terms] = 0
            order = np.argsort(-bounds, axis=1, kind="stable")
            for item, found in enumerate(held):
                a, b = first[item], first[item + 1]
                for k in order[item].tolist():
                    least = -found[-1][0] if len(found) >= top else 1
                    if bounds[item, k] < least:
                        break
                    found += own[k].best(own[k].scores(term[a:b], value[a:b]), least, top)
                    found.sort()
                    del found[top:]
        rows = [(item, None if none else i, -s) for item, found in enumerate(held) for s, none, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return segments.mapInArrow(visit, "item int, doc_id bigint, score bigint")
