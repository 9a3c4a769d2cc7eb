"""Operator 3: benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

1. ``seeds``: the word trigrams of all test items are counted in the corpus (``occurrences``). Those that occur, but rarely, are
   seeds; those that do not occur find nothing. A trigram is rare up to ``COMMON`` places and ``SHARE`` of all places, or up
   to twice as many as its item's rarest has, so that a passage copied everywhere keeps its seeds and every item has
   some. In place of a common trigram stand the runs of four words around it, which are rarer: the surviving words
   of an edited copy may be common ones.
2. ``passages``: words around every place where a seed of an item occurs in a document, one passage
   for places that lie close together. Two ways give the same rows: seeds up to ``BROADCAST_SEEDS``
   go to the tasks that read the texts; more of them meet the documents' trigrams in a shuffled join,
   and the texts follow by doc_id and a hash of the text.
3. ``_align``: local alignment of the passage's and the item's words (match 2, mismatch and gap -1),
   after a bound by shared words. The score is divided by what the whole item would reach.

Words are maximal runs of non-blank characters in lower case (A-Z). Items of fewer than three words
have no trigram and match nothing; null and empty texts match nothing. Rows that agree in doc_id give
the best score of either; rows with null doc_id are reported under null, together. Of equal scores the
earliest place counts, then the most seeds. Repeated items give their rows once. ``decontaminate`` judges
rows apart, whatever their doc_ids. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import told_apart, written
from spanloom.llm.grams import Words, grams, members, text_slices, words

SEED = 3
#: Places that a trigram may have and still be rare: so many, and such a share of all places beyond them.
COMMON, SHARE = 1000, 1e-6
THRESHOLD = 0.5
#: Seeds of at most this number are broadcast (about 24 bytes each).
BROADCAST_SEEDS = 2_000_000
#: The words that ``grams.words`` counts; ``str.split`` would also cut at other blanks.
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PASSAGE = "doc_id bigint, item_id bigint, at bigint, seeds int, passage string"


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast_seeds: int = BROADCAST_SEEDS, common: int = COMMON) -> DataFrame:
    """(doc_id, item_id, score, seeds, at_word) of each pair that aligns at the threshold or better."""
    texts = docs.select("doc_id", "text")
    items = items.select(F.col("item_id").cast("bigint"), "text").where("text IS NOT NULL AND item_id IS NOT NULL").distinct()
    planted = seeds(texts, items, broadcast_seeds, common)
    small = planted.count() <= broadcast_seeds
    found = passages_in_place(texts, planted) if small else passages_joined(texts, planted)
    scored = found.join(items.withColumnRenamed("text", "item"), "item_id").mapInArrow(lambda batches: _align(batches, threshold), "doc_id bigint, item_id bigint, score double, seeds int, at_word bigint")
    best = F.max(F.struct("score", (-F.col("at_word")).alias("before"), "seeds")).alias("best")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.seeds", (-F.col("best.before")).alias("at_word"))


def seeds(texts: DataFrame, items: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS, common: int = COMMON) -> DataFrame:
    """(h, item_id, item_at, item_words, size): the items' rare trigrams, and runs of four words around their common ones."""
    threes = written(item_grams(items, SEED), "item-grams")
    counted = written(occurrences(texts, threes, broadcast_seeds), "seed-counts")
    places = counted.where("h IS NULL").agg(F.sum("n")).first()[0] or 0
    met = threes.join(counted, "h")
    least = met.groupBy("item_id").agg((F.min("n") * 2).alias("allowed"))
    judged = met.join(least, "item_id").withColumn("rare", F.col("n") <= F.greatest(F.lit(int(common + SHARE * places)), "allowed"))
    judged = written(judged.select("h", "item_id", "item_at", "item_words", "rare"), "judged-seeds")
    rare = judged.where("rare").drop("rare").withColumn("size", F.lit(SEED))
    dull = judged.where("NOT rare").select("item_id", "item_words", F.explode(F.array(F.col("item_at") - 1, "item_at")).alias("item_at")).distinct()
    if dull.isEmpty():
        return written(rare.distinct(), "seeds")
    fours = item_grams(items, SEED + 1).join(dull, ["item_id", "item_words", "item_at"], "left_semi").withColumn("size", F.lit(SEED + 1))
    return written(rare.unionByName(fours).distinct(), "seeds")


def occurrences(texts: DataFrame, threes: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(h, n): places of each of the trigrams in all texts, summed in each batch first; under null, those of all trigrams."""
    wanted = threes.select("h").distinct()
    known = None
    if wanted.count() <= broadcast_seeds:
        known = texts.sparkSession.sparkContext.broadcast(np.sort(wanted.toPandas()["h"].to_numpy().view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in text_slices(batch["text"]):
                _, g = grams(words(part, lower=True), SEED)
                every = len(g)
                if known is not None:
                    g = g[members(known.value, g)]
                h, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([*h.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(n, every).astype(np.int64))], ["h", "n"])

    found = texts.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    return found if known is not None else found.join(wanted.withColumn("wanted", F.lit(True)), "h", "left").where("wanted OR h IS NULL").drop("wanted")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows in which no test item aligns."""
    numbered, row = told_apart(docs)
    bad = leaks(numbered.select(F.col(row).alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias(row)).distinct()
    return numbered.join(bad, row, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def item_grams(items: DataFrame, size: int) -> DataFrame:
    """(h, item_id, item_at, item_words): every run of ``size`` words of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in text_slices(batch["text"]):
                w = words(part, lower=True)
                at, g = grams(w, size)
                owner = w.text_of[at]
                ids = batch["item_id"].slice(i, j - i).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), ids, pa.array(w.place[at].astype(np.int32)), pa.array(w.counts[owner].astype(np.int32))], ["h", "item_id", "item_at", "item_words"])

    return items.mapInArrow(run, "h bigint, item_id bigint, item_at int, item_words int")


def _runs(w: Words, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the runs of each of the sizes."""
    each = [grams(w, size) for size in sizes]
    return np.concatenate([at for at, _ in each]), np.concatenate([g for _, g in each])


def _sizes(planted: DataFrame) -> list[int]:
    return sorted(r["size"] for r in planted.select("size").distinct().collect()) or [SEED]  # two at most


def corpus_grams(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(h, doc_id, own, at): every run of these sizes of every document; ``own`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in text_slices(batch["text"]):
                w = words(part, lower=True)
                at, g = _runs(w, sizes)
                ids, own = (batch[c].slice(i, j - i).take(pa.array(w.text_of[at])) for c in ("doc_id", "own"))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), ids, own, pa.array(w.place[at])], ["h", "doc_id", "own", "at"])

    return texts.mapInArrow(run, "h bigint, doc_id bigint, own bigint, at bigint")


def passages_in_place(texts: DataFrame, planted: DataFrame) -> DataFrame:
    """Passages around the seeds, cut where the texts are read."""
    sizes = _sizes(planted)
    table = planted.toPandas().sort_values("h", key=lambda c: c.to_numpy().view(np.uint64))
    sent = texts.sparkSession.sparkContext.broadcast((table["h"].to_numpy().view(np.uint64), *(table[c].to_numpy().astype(np.int64) for c in ("item_id", "item_at", "item_words"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, item_id, item_at, item_words = sent.value
        for batch in batches:
            for i, _, part in text_slices(batch["text"]):
                w = words(part, lower=True)
                at, g = _runs(w, sizes)
                hit = members(keys, g)
                at, g = at[hit], g[hit]
                low, high = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
                each = np.repeat(np.arange(len(g)), high - low)
                seed = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[each]
                owner, place = w.text_of[at][each], w.place[at][each]
                rows = []
                for text in np.unique(owner):
                    mine = owner == text
                    own = _WORD.findall(part[int(text)].as_py())
                    rows += _cut(batch["doc_id"][i + int(text)].as_py(), own, item_id[seed[mine]], place[mine] - item_at[seed[mine]], item_words[seed[mine]])
                yield _passage_batch(rows)

    return texts.mapInArrow(run, _PASSAGE)


def passages_joined(texts: DataFrame, planted: DataFrame) -> DataFrame:
    """The same passages when the seeds are too many to send: both sides are shuffled."""
    keyed = texts.withColumn("own", F.xxhash64("text"))
    # a set of hits, so that rows that agree in doc_id and text do not count theirs twice
    hits = corpus_grams(keyed, _sizes(planted)).join(planted, "h").groupBy("doc_id", "own").agg(F.collect_set(F.struct("item_id", "at", "item_at", "item_words", "size")).alias("hits"))
    hits = hits.withColumnsRenamed({"doc_id": "of_doc", "own": "of_text"})
    both = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("own") == F.col("of_text"))).select("doc_id", "text", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "hits")), strict=True):
                item_id, at, item_at, item_words = (np.array([h[c] for h in found], np.int64) for c in ("item_id", "at", "item_at", "item_words"))
                rows += _cut(doc_id, _WORD.findall(text or ""), item_id, at - item_at, item_words)
            yield _passage_batch(rows)

    return both.mapInArrow(run, _PASSAGE)


def _cut(doc_id: int | None, own: list[str], item_id: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple]:
    """A passage for each run of near starts of one item."""
    rows = []
    order = np.lexsort((start, item_id))
    item_id, start, size = item_id[order], start[order], size[order]
    new = np.concatenate([[True], (item_id[1:] != item_id[:-1]) | (start[1:] - start[:-1] > size[1:])])
    for low, high in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(start)), strict=True):
        n = int(size[low])
        a = max(0, int(start[low]) - n // 4 - 2)
        rows.append((doc_id, int(item_id[low]), a, int(high - low), " ".join(own[a : int(start[high - 1]) + n + n // 4 + 2])))
    return rows


def _passage_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("at", pa.int64()), ("seeds", pa.int32()), ("passage", pa.string())]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def align(item: list[str], passage: list[str]) -> tuple[float, int]:
    """Best local alignment score over that of the whole item, and the passage word where it ends."""
    seen: dict[str, int] = {}
    a = np.array([seen.setdefault(x, len(seen)) for x in item])
    b = np.array([seen.setdefault(x, len(seen)) for x in passage])
    slope = np.arange(len(b) + 1)
    row, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for x in a:
        new = np.zeros(len(b) + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(b == x, 2, -1), row[1:] - 1)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope) - slope  # gaps along the passage
        if (top := int(row.argmax())) and row[top] > best:
            best, end = int(row[top]), top - 1
    return best / (2 * len(a)), end


def _align(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, item_id, at, n, passage, item in zip(*(batch[c].to_pylist() for c in ("doc_id", "item_id", "at", "seeds", "passage", "item")), strict=True):
            a, b = _WORD.findall(item.translate(_FOLD)), _WORD.findall(passage.translate(_FOLD))
            if (Counter(a) & Counter(b)).total() < threshold * len(a):
                continue
            score, end = align(a, b)
            if score >= threshold:
                rows.append((doc_id, item_id, score, n, at + end))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "seeds", "at_word"])
