"""Operator 5: language ID by Bayesian evidence fusion.

Four kinds of evidence are added as log-odds:

* text: naive Bayes over hashed letter trigrams of the whole text. It is fitted on a bounded sample,
  ``PER_LANGUAGE`` labelled texts a language, drawn by a hash of doc_id and text. A language is the primary
  subtag of ``lang`` (the whole value where it has none). All are kept; more than ``MOST_LANGUAGES`` are an
  error, as such a column holds no languages. The trigrams of a text overlap and repeat, so their mean
  log-likelihood counts as ``TEXT_WEIGHT`` observations at most.
* declared language (markup or a column): how often it is declared for each language.
* address suffix: the share of each language under that suffix against its share overall.
* host prior: the language shares of a host, smoothed towards those of its domain, which are smoothed
  towards those of the corpus.

The last three are grouped sums of the text posteriors over all rows, with partial aggregation, so a
host with a third of all rows costs a row a task. Hosts and suffixes come back by equi-joins on tables
that are written first; adaptive execution splits hot keys.

A text without letters has no language and is rejected; so is a text whose best posterior is below
``LEAST_POSTERIOR``. Ties take the first language by name. Null and empty texts, hosts, suffixes and
declarations are no evidence. Rows are not told apart by id, so repeated rows each give a row. The
input's columns but the text are kept; ``language``, ``language_posterior`` and ``language_kept`` replace
columns of those names. Where no row has a language, no text has one. The label of documents is what the
model is fitted on, so ``document_records`` holds it out of the declared evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from spanloom.llm.common import fresh, written
from spanloom.llm.grams import text_slices

#: Labelled texts a language, and the most languages, which bound what the driver collects: CELLS rows each.
PER_LANGUAGE, MOST_LANGUAGES = 1000, 4096
CELLS = 1 << 14
#: Text whose trigrams are counted at once.
SLICE_BYTES = 1 << 19
TEXT_WEIGHT = 40.0
HOST_WEIGHT, DOMAIN_WEIGHT, DECLARED_WEIGHT, SUFFIX_WEIGHT = 20.0, 50.0, 5.0, 20.0
LEAST_POSTERIOR = 0.5

#: ASCII letters fold to lower case, other ASCII to blank; bytes of other letters stay.
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[:128] = 0x20
for _c in range(0x61, 0x7B):
    _LETTER[_c] = _LETTER[_c - 0x20] = _c


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, cell) of each byte trigram of letters, a word's two edges included."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in texts], np.int64)
    padded = b" " + b" ".join(x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts) + b" "
    data = _LETTER[np.frombuffer(padded, np.uint8)]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = (data[k : len(data) - 2 + k].astype(np.uint32) for k in range(3))
    code = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35)) >> np.uint32(18)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)[: len(code)]  # of the middle byte, which is never between texts
    solid = (b != 0x20) & ((a != 0x20) | (c != 0x20))
    return owner[solid], code[solid].astype(np.int64)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities by cell, from ``labelled(doc_id, text, lang)``."""
    tag = F.coalesce(primary_tag(F.col("lang")), F.lower("lang")).alias("lang")
    labels = labelled.where("trim(lang) != '' AND text IS NOT NULL")
    # a row a language; a hash bound lets through half as many again as are wanted, so that no task sorts more
    counted = written(labels.groupBy(tag).agg(F.count("*").alias("n")), "language-counts")
    if counted.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    drawn = F.xxhash64("doc_id", "text")
    rows = labels.select("doc_id", "text", tag, drawn.alias("drawn")).join(counted, "lang")
    likely = rows.where((F.col("drawn").cast("double") / F.lit(2.0**64) + 0.5) * F.col("n") <= 1.5 * per_language + 50)
    ranked = likely.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY drawn, doc_id) AS r").where(F.col("r") <= per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in text_slices(batch["text"], SLICE_BYTES):
                owner, cell = trigrams(part)
                langs = batch["lang"].slice(i, j - i).dictionary_encode()
                own = langs.indices.to_numpy(zero_copy_only=False)[owner].astype(np.int64) * CELLS + cell
                codes, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(codes // CELLS)), pa.array((codes % CELLS).astype(np.int32)), pa.array(n)], ["lang", "cell", "n"])

    counted = ranked.select("text", "lang").mapInArrow(run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # at most CELLS rows a language from a bounded sample
    languages = sorted(set(table["lang"]))
    counts = np.full((len(languages), CELLS), 0.5)
    counts[table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64), table["cell"].to_numpy(dtype=np.int64)] += table["n"].to_numpy()
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", declared: str = "declared", host: str = "host", suffix: str = "suffix") -> DataFrame:
    """Add language (null: none), language_posterior and language_kept to the rows, in place of columns of these names.

    All other columns but the text stay, whatever their names.
    """
    languages, logs = model
    n = len(languages)
    added = ["language", "language_posterior", "language_kept"]
    inner = ["language_letters", "language_loglik", "language_text", "language_host", "language_suffix", "language_said", "language_sum", "language_top"]
    rows = rows.drop(*[c for c in rows.columns if c.lower() in added])
    # columns with names that are used inside go by others meanwhile
    others = {c: name for c, name in zip(rows.columns, fresh(rows.select(), *[f"{c}_" if c.lower() in inner else c for c in rows.columns]), strict=True)}
    given, kept = rows.columns, [c for c in rows.columns if c != text]
    rows = rows.toDF(*[others[c] for c in given])
    text, declared, host, suffix = (others[c] for c in (text, declared, host, suffix))
    if not n:
        return rows.drop(text).toDF(*kept).withColumns({"language": F.lit(None).cast("string"), "language_posterior": F.lit(0.0), "language_kept": F.lit(False)})
    scored = written(_text_evidence(rows, logs, text), "text-evidence")
    mass = [F.sum(F.col("language_text")[i]).alias(f"c{i}") for i in range(n)]

    def grouped(by: str) -> DataFrame:
        return scored.where("language_letters > 0").groupBy(by).agg(F.array(*[F.coalesce(m, F.lit(0.0)) for m in mass]).alias("mass")).where(F.col(by).isNotNull())

    overall = scored.where("language_letters > 0").agg(F.array(*[F.coalesce(m, F.lit(0.0)) for m in mass])).first()[0]
    total = sum(overall) or 1.0
    share = [(x + 1.0) / (total + n) for x in overall]
    base = F.lit(share)

    def smoothed(counts: Column, towards: Column, weight: float) -> Column:
        own = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(counts, towards, lambda c, t: (c + weight * t) / (own + weight))

    hosts = grouped(host).withColumn("domain", F.regexp_extract(F.col(host), r"([^.]*\.[^.]*|[^.]*)$", 1))
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("mass")[i]) for i in range(n)]).alias("domain_mass"))
    priors = written(hosts.join(domains, "domain").select(F.col(host), smoothed(F.col("mass"), smoothed(F.col("domain_mass"), base, DOMAIN_WEIGHT), HOST_WEIGHT).alias("language_host")), "host-priors")
    suffixes = written(grouped(suffix).select(F.col(suffix), F.zip_with(smoothed(F.col("mass"), base, SUFFIX_WEIGHT), base, lambda s, g: s / g).alias("language_suffix")), "suffixes")
    said = written(grouped(declared).select(F.col(declared), F.zip_with(smoothed(F.col("mass"), base, DECLARED_WEIGHT), base, lambda s, g: s / g).alias("language_said")), "declared")

    joined = scored.join(priors, host, "left").join(suffixes, suffix, "left").join(said, declared, "left")
    ones = F.array_repeat(F.lit(1.0), n)
    evidence = [F.col("language_loglik"), F.transform(F.coalesce("language_host", base), F.ln), F.transform(F.coalesce("language_suffix", ones), F.ln), F.transform(F.coalesce("language_said", ones), F.ln)]
    summed = evidence[0]
    for e in evidence[1:]:
        summed = F.zip_with(summed, e, lambda a, b: a + b)
    fused = joined.withColumn("language_sum", summed).withColumn("language_top", F.array_max("language_sum"))
    best = 1.0 / F.aggregate("language_sum", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("language_top")))
    out = fused.withColumn("language_posterior", F.when(F.col("language_letters") > 0, best).otherwise(0.0))
    name = F.get(F.lit(languages), (F.array_position("language_sum", F.col("language_top")) - 1).cast("int"))
    out = out.withColumn("language", F.when(F.col("language_letters") > 0, name)).withColumn("language_kept", F.col("language_posterior") >= LEAST_POSTERIOR)
    return out.select(*[F.col(others[c]).alias(c) for c in kept], *added)


def _text_evidence(rows: DataFrame, logs: np.ndarray, text: str) -> DataFrame:
    """Drop the text; add its trigram count, weighted log-likelihoods and posterior."""
    others = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in text_slices(batch[text], SLICE_BYTES):
                owner, cell = trigrams(part)
                size = np.bincount(owner, minlength=j - i)
                sums = np.stack([np.bincount(owner, weights=row[cell], minlength=j - i) for row in logs], axis=1)
                mean = sums / np.maximum(size, 1)[:, None] * np.minimum(size, TEXT_WEIGHT)[:, None]
                shifted = np.exp(mean - mean.max(axis=1, keepdims=True))
                posterior = shifted / shifted.sum(axis=1, keepdims=True)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * len(logs)), pa.array(x.reshape(-1))) for x in (mean, posterior)]
                yield pa.RecordBatch.from_arrays([*[batch[c].slice(i, j - i) for c in others], pa.array(size), *lists], [*others, "language_letters", "language_loglik", "language_text"])

    schema = StructType([*rows.select(*others).schema, StructField("language_letters", LongType()), StructField("language_loglik", ArrayType(DoubleType())), StructField("language_text", ArrayType(DoubleType()))])
    return rows.select(*others, text).mapInArrow(run, schema)


def primary_tag(column: Column) -> Column:
    """The primary subtag of a declared language, or null."""
    tag = F.regexp_extract(F.lower(column), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1)
    return F.when(tag != "", tag)


def page_records(pages: DataFrame) -> DataFrame:
    """page_id, text without markup, declared language, host and suffix of raw web pages."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")
    name = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    named = pages.select("page_id", text.alias("text"), primary_tag(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1)).alias("declared"), F.when(name != "", name).alias("host"))
    suffix = F.regexp_extract("host", r"\.([a-z]+)$", 1)
    return named.withColumn("suffix", F.when(suffix != "", suffix))


def document_records(docs: DataFrame) -> DataFrame:
    """doc_id, text and host (the source) of documents; they declare nothing, as lang is the label."""
    return docs.select("doc_id", "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
