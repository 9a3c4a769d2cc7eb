"""Registered queries of the corpus operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import lexical_search, licenses, merkle
from spanloom.llm.common import documents, new_path
from spanloom.llm.decontaminate import leaks
from spanloom.llm.fingerprints import compare_with_next
from spanloom.llm.language import document_records, fit, identify, page_records
from spanloom.llm.line_dedup import line_dedup
from spanloom.llm.minhash_dedup import minhash_dedup
from spanloom.llm.packing import pack
from spanloom.llm.simhash_dedup import simhash_dedup
from spanloom.llm.substring_dedup import substring_dedup
from spanloom.llm.token_counts import count_tokens
from spanloom.llm.token_files import read_tokens, write_tokens

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word repeats of earlier documents, removed; the digest of what is left."""
    return substring_dedup(documents(spark, sf_dir), keep_text=False)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of later three-line windows removed; the digest of what is left."""
    cleaned = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select("doc_id", F.col("line_dedup_lines").alias("n_lines"), F.col("line_dedup_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item that align."""
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, compared with each other and the next."""
    return compare_with_next(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and every page; one of doc_id and page_id is null."""
    docs = documents(spark, sf_dir)
    rows = document_records(docs).withColumn("page_id", F.lit(None).cast("bigint"))
    rows = rows.unionByName(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("doc_id", F.lit(None).cast("bigint")))
    return identify(rows, fit(docs)).select("doc_id", "page_id", "language", "language_posterior", F.col("language_kept").alias("kept"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every text."""
    return count_tokens(documents(spark, sf_dir))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 4-word shingle sets at 0.8."""
    return minhash_dedup(documents(spark, sf_dir), shingle=4, threshold=0.8).select("doc_id", "n_shingles", "component_id", "kept")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every text."""
    return licenses.license_scan(documents(spark, sf_dir))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of every text in sequences of 2048."""
    return pack(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, from binary files that were written and read back."""
    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path)
    return read_tokens(spark, path, with_ids=False)


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in three bits or fewer."""
    return simhash_dedup(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents against the manifest, and what tampered ones fold to."""
    return merkle.proofs(merkle.manifest(documents(spark, sf_dir)))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of ``corpus_pipeline`` over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_fingerprints": op4_fingerprints,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_pack": op9_pack,
    "op10_token_files": op10_token_files,
    "op11_simhash_dedup": op11_simhash_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS p FROM words WHERE len(w) >= 13),
windows AS (SELECT doc_id, p, list_slice(w, p, p + 12) AS g FROM places),
firsts AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p
  FROM windows JOIN firsts USING (g) WHERE least < doc_id),
each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (
  SELECT e.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY e.p) AS body
  FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
       CAST(len(d.w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op2_line_dedup": r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, p, l[p] AS a, l[p + 1] AS b, l[p + 2] AS c
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM docs WHERE len(l) >= 3)),
full_windows AS (SELECT * FROM windows WHERE trim(translate(a || b || c, chr(9) || chr(13), '  ')) <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS r FROM full_windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS p FROM ranked WHERE r > 1),
each_line AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM docs),
kept AS (
  SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.p) AS body, count(*) AS n
  FROM each_line e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(l), 0) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op7_minhash_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS g FROM words),
classes AS MATERIALIZED (SELECT min(doc_id) AS rep, g, len(g) AS n FROM sets WHERE len(g) > 0 GROUP BY g),
shingles AS MATERIALIZED (SELECT rep, n, unnest(g) AS s FROM classes),
links AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
  SELECT rep AS node, rep AS other FROM classes
  UNION
  SELECT r.node, e.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON r.other = e.a),
components AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id, s.doc_id = coalesce(component, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON s.g = c.g LEFT JOIN components ON node = rep
""",
    "op8_license_scan": licenses.oracle_sql(),
    "op12_merkle_manifest": r"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
fields AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
         list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: unicode(substr(doc_id::VARCHAR, i, 1))::BIGINT) AS digits
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN n_chars IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, digits), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0
              THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS other
  FROM fields, bytes),
places AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves),
up AS (
  SELECT tree, 0 AS level, idx, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM places
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, level, idx // 2),
subroots AS (SELECT tree, node FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, tree AS idx, node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, idx // 2),
inner_steps AS (
  SELECT p.tree, p.idx, list(coalesce(CASE WHEN (p.idx >> l.level) % 2 = 0 THEN 'R' ELSE 'L' END || s.node, 'N') ORDER BY l.level) AS steps
  FROM places p JOIN (SELECT DISTINCT tree, level FROM up WHERE n > 1) l ON p.tree = l.tree
  LEFT JOIN up s ON s.tree = p.tree AND s.level = l.level AND s.idx = xor(p.idx >> l.level, 1) GROUP BY p.tree, p.idx),
top_steps AS (
  SELECT r.tree, list(coalesce(CASE WHEN (r.tree >> l.level) % 2 = 0 THEN 'R' ELSE 'L' END || s.node, 'N') ORDER BY l.level) AS steps
  FROM subroots r CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) l
  LEFT JOIN top s ON s.level = l.level AND s.idx = xor(r.tree >> l.level, 1) GROUP BY r.tree),
paths AS (
  SELECT p.doc_id, p.leaf, r.node AS subroot, t.node AS root, coalesce(p.other, p.leaf) AS start, list_concat(coalesce(i.steps, []), coalesce(o.steps, [])) AS steps
  FROM places p JOIN subroots r ON p.tree = r.tree CROSS JOIN (SELECT node FROM top WHERE n = 1) t
  LEFT JOIN inner_steps i ON i.tree = p.tree AND i.idx = p.idx LEFT JOIN top_steps o ON o.tree = p.tree),
folded AS (
  SELECT *, list_reduce(list_prepend(start, steps), lambda h, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || h ELSE h || s[2:] END)) AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
""",
    "op13_lexical_search": r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
totals AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS length FROM texts),
counts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM texts) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
lengths AS (SELECT r, doc_id, 25 + (75 * len(t) * n_docs) // length AS m FROM texts, totals WHERE len(t) > 0),
scored AS (
  SELECT item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (r) GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0) WHERE place <= 10
""",
}
