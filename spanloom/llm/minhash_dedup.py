"""Operator 7: near-duplicate documents by one-permutation MinHash.

1. ``sketches`` reads every text once. A document's set is its distinct word shingles (lower-cased
   A-Z; a text with fewer words is one shingle). One hash a shingle fills one of ``bins`` bins with
   its minimum; empty bins borrow from a bin that their own hash sequence picks (optimal
   densification), and runs of ``rows`` bins make band keys.
2. Documents with equal sets are one class, represented by the least doc_id. Only representatives
   take part in what follows, so copies cost nothing.
3. Band keys that several representatives share are buckets. A bucket of m yields at most 2(m-1)
   candidate pairs: a star around its best connected member (the one with most company over all its
   buckets, usually what the others were copied from), and one around its least doc_id.
   A star that has met its bucket leaves it. What is left of a bucket and lies in more than one component
   draws further stars: all members where at most ``SMALL`` are left, else ``STARS`` by hash, and
   ``MORE`` times as many in each later round. Stars meet only members of other components, and no pair
   is compared twice. Rounds end when no bucket is open, so the components are those of all pairs that
   share a bucket. Pairs are made only where set sizes and ``bitmaps`` allow the threshold: a cell that
   one set fills and the other does not is an element that they do not share, so no link is lost.
4. ``_confirm`` recomputes the whole sets of both ends of each pair and keeps pairs with
   intersection / union at or above the threshold. A star's members come in blocks, each with a copy
   of the star's text, so that a star of any size is spread over tasks.
5. Components of the confirmed links and the classes give each document its component. Links inside a
   known component are not looked for, as they change none.

With 512 bins in bands of 8 rows a pair at 0.8 is missed by all 64 bands with probability 1e-5.

Null and empty texts have no shingles and no links. Rows with one doc_id are one node: what any of them
reaches, all reach. A row with a null doc_id cannot be linked: its component is null and it is kept. Other
columns are ignored. The pipeline numbers rows apart first, so that there rows are the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import written
from spanloom.llm.components import connected_components
from spanloom.llm.grams import members, mix, shingle_sets, text_slices, words

BINS, ROWS = 512, 8
#: Members of a star that are compared in one group, and shingles of theirs.
STAR_BLOCK, BLOCK_SHINGLES = 200, 1_000_000
#: Further stars of a large bucket in its second round, how many times more in each later one, and the
#: most members of a bucket that are all stars.
STARS, MORE, SMALL = 4, 16, 8
#: Longs of a set's bitmap.
LONGS = 16


def minhash_dedup(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept, n_links.

    ``n_links`` counts the confirmed links of the document's class representative.
    """
    texts = docs.select("doc_id", "text")
    made = sketches(texts, shingle, bins, rows)
    classes = made.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"), F.first("bits").alias("bits"))
    classes = written(classes, "classes")
    links, components = _linked(texts, classes, shingle, threshold, _same_document(made, classes))
    n_links = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    found = components.join(n_links, "rep", "left")
    of_class = classes.drop("bands", "size", "bits").join(found, "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    own = made.select("doc_id", "n_shingles", "set_a", "set_b")
    out = own.where("n_shingles > 0 AND doc_id IS NOT NULL").join(of_class, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.col("component").alias("component_id"), "n_links")
    alone = own.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_document(made: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(a, b): classes that share a doc_id, by their representatives; nothing where no doc_id has two sets."""
    sets = F.struct("set_a", "set_b")
    mixed = made.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(sets).alias("low"), F.max(sets).alias("high")).where("low != high").select("doc_id")
    mixed = written(mixed, "mixed")
    if mixed.isEmpty():
        return None
    reps = made.join(mixed, "doc_id").join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).select("doc_id", "rep")
    low = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return written(reps.join(low, "doc_id").where("a != rep").select("a", F.col("rep").alias("b")).distinct(), "same-document")


def sketches(texts: DataFrame, shingle: int, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, its band keys and its bitmap; written, as it is read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in text_slices(batch["text"]):
                owner, g = shingle_sets(words(part, lower=True), shingle)
                n = j - i
                sizes = np.bincount(owner, minlength=n)
                some = np.flatnonzero(sizes)
                heads = np.cumsum(sizes[some]) - sizes[some]
                set_a, set_b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                keys = np.zeros((n, bins // rows), np.uint64)
                bits = bitmaps(owner, g, n)
                if len(some):
                    set_a[some], set_b[some] = (np.add.reduceat(mix(g, k), heads) for k in (11, 13))
                    keys[some] = band_keys(signatures(np.repeat(np.arange(len(some)), sizes[some]), mix(g, 17), len(some), bins), rows)
                flat = pa.array(keys.reshape(-1).view(np.int64))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (bins // rows)), flat)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, n), pa.array(sizes.astype(np.int64)), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), bands, bits], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"])

    return written(texts.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, bits array<bigint>"), "sketches")


def bitmaps(owner: np.ndarray, g: np.ndarray, n: int) -> pa.ListArray:
    """A bit for each of the cells that the hashes of a set fill."""
    full = np.zeros((n, LONGS * 64), bool)
    full[owner, (mix(g, 23) % np.uint64(LONGS * 64)).astype(np.int64)] = True
    packed = np.packbits(full, axis=1).reshape(-1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * LONGS), pa.array(packed))


def signatures(owner: np.ndarray, g: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """One-permutation signature of each of ``n`` sets given as (owner, mixed hash)."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    shift = np.uint64(64 - (bins - 1).bit_length())
    cell = owner * bins + (g >> shift).astype(np.int64)
    order = np.lexsort((g, cell))
    cell, g = cell[order], g[order]
    heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    raw = np.full(n * bins, none, np.uint64)
    raw[cell[heads]] = g[heads] & ((np.uint64(1) << shift) - np.uint64(1))
    raw = raw.reshape(n, bins)
    full, out = raw != none, raw.copy()
    row, column = np.nonzero(~full)
    attempt = 0
    while len(row):
        attempt += 1
        donor = (mix(np.arange(bins, dtype=np.uint64) * np.uint64(1 << 20), attempt) % np.uint64(bins)).astype(np.int64)[column]
        lucky = full[row, donor]
        out[row[lucky], column[lucky]] = raw[row[lucky], donor[lucky]]
        row, column = row[~lucky], column[~lucky]
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, bins = signature.shape
    parts = signature.reshape(n, bins // rows, rows)
    with np.errstate(over="ignore"):
        key = np.tile(mix(np.arange(bins // rows, dtype=np.uint64), 19), (n, 1))
        for k in range(rows):
            key = mix(key ^ parts[:, :, k])
    return key


def _linked(texts: DataFrame, classes: DataFrame, shingle: int, threshold: float, given: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) and components (rep, component) of the representatives that share band keys.

    ``given`` links take part in the components only.
    """
    rows = classes.select(F.explode("bands").alias("key"), "rep", "size")
    shared = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    inside = written(rows.join(shared, "key").join(classes.select("rep", "bits"), "rep"), "bucket-members")
    company = inside.groupBy("rep").agg(F.sum("n").alias("company"))
    one = F.struct("rep", "size", "component", "bits")
    left = inside.select("key", "rep", "size", "bits", F.col("rep").alias("component"))
    best = F.max_by(one, F.struct("company", -F.col("rep"))).alias("s")
    stars = left.join(company, "rep").groupBy("key").agg(best, F.min_by(one, "rep").alias("low")).select("key", F.explode(F.array_distinct(F.array("s", "low"))).alias("s"))
    links, compared, components, drawn = None, None, None, STARS
    while True:
        stars = written(stars.select("key", F.col("s.rep").alias("star"), F.col("s.size").alias("star_size"), F.col("s.component").alias("star_component"), F.col("s.bits").alias("star_bits")), "stars")
        pairs = written(_pairs(left, stars, compared, threshold), "pairs")
        compared = pairs if compared is None else compared.unionByName(pairs)
        if links is None or not pairs.isEmpty():
            new = written(_confirm(texts, pairs.select("star", "member", "weight"), shingle, threshold), "confirmed")
            if links is None or not new.isEmpty():
                links = new if links is None else links.unionByName(new)
                components = connected_components(links if given is None else links.unionByName(given)).withColumnRenamed("node", "rep")
        placed = left.drop("component").join(components, "rep", "left").select("key", "rep", "size", "bits", F.coalesce("component", "rep").alias("component"))
        # most buckets lie in one component by now and are closed as they are; only the others are looked at row by row
        maybe = written(_open(placed).select("key"), "maybe-open")
        if maybe.isEmpty():
            return links, components
        rest = placed.join(maybe, "key").join(stars.select("key", F.col("star").alias("rep")), ["key", "rep"], "left_anti")
        open_members = written(rest.join(_open(rest), "key"), "open-members")
        if open_members.isEmpty():
            return links, components
        order = F.xxhash64("rep", "key")
        part = F.when(F.col("n_left") <= F.greatest(F.lit(SMALL), F.lit(drawn)), F.col("rep")).otherwise(F.pmod(order, F.lit(drawn)))
        left = open_members.drop("n_left")
        stars = open_members.groupBy("key", part.alias("part")).agg(F.min_by(one, order).alias("s")).select("key", "s")
        drawn *= MORE


def _open(members_of: DataFrame) -> DataFrame:
    """(key, n_left) of the buckets whose members lie in several components."""
    found = members_of.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n_left"))
    return found.where("low < high").select("key", "n_left")


def _pairs(members_of: DataFrame, stars: DataFrame, compared: DataFrame | None, threshold: float) -> DataFrame:
    """(a, b, star, member, weight): stars and members of other components, of sets that allow a link, not compared before.

    The weight is the number of the member's shingles.
    """
    threshold = round(threshold * 10_000) / 10_000  # as ``_compare`` takes it
    near = F.least("size", "star_size") >= F.greatest("size", "star_size") * (threshold - 1e-9)
    apart = sum((F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("star_bits", F.lit(k)))) for k in range(LONGS)), F.lit(0))
    near &= apart <= (F.col("size") + F.col("star_size")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    met = members_of.join(stars, "key").where((F.col("component") != F.col("star_component")) & near)
    each = met.groupBy(F.least("star", "rep").alias("a"), F.greatest("star", "rep").alias("b")).agg(F.min(F.struct("star", "size")).alias("m")).select("a", "b", "m.star", F.col("m.size").alias("weight"))
    if compared is not None:
        each = each.join(compared, ["a", "b"], "left_anti")
    return each.select("a", "b", "star", (F.col("a") + F.col("b") - F.col("star")).alias("member"), "weight")


def _confirm(texts: DataFrame, pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(a, b) for the pairs whose whole sets are similar enough."""
    blocks = pairs.groupBy("star").agg(F.ceil(F.greatest(F.count("*") / STAR_BLOCK, F.sum("weight") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocks = written(blocks, "blocks")
    members_of = pairs.join(blocks, "star").select(F.col("member").alias("doc_id"), "star", F.pmod(F.xxhash64("member"), "blocks").cast("int").alias("block"))
    stars = blocks.select(F.col("star").alias("doc_id"), "star", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    roles = members_of.unionByName(stars)
    placed = roles.join(texts.where("doc_id IS NOT NULL"), "doc_id").select("star", "block", "doc_id", "text")
    return placed.groupBy("star", "block").applyInArrow(lambda t: _compare(t, shingle, threshold), "a bigint, b bigint")


def _compare(table: pa.Table, shingle: int, threshold: float) -> pa.Table:
    """Links between the star and the other rows of its block."""
    star = table["star"][0].as_py()
    ids = table["doc_id"].to_numpy()
    percent = round(threshold * 10_000)
    linked: set[int] = set()
    for s in np.flatnonzero(ids == star):
        _, whole = shingle_sets(words(table["text"].slice(s, 1).combine_chunks(), lower=True), shingle)
        for i, j, part in text_slices(table["text"]):
            owner, g = shingle_sets(words(part, lower=True), shingle)
            sizes = np.bincount(owner, minlength=j - i)
            both = np.bincount(owner, weights=members(whole, g), minlength=j - i).astype(np.int64)
            near = (10_000 * both >= percent * (sizes + len(whole) - both)) & (sizes > 0)
            linked |= set(ids[i:j][near].tolist())
    linked.discard(star)
    other = np.array(sorted(linked), dtype=np.int64)
    return pa.table({"a": np.minimum(other, star), "b": np.maximum(other, star)}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
