"""Operator 8: license scans by an exact set-similarity join, with DataFrame functions only.

Two kinds of evidence. *Base phrases* are runs of consecutive words. *Templates* are license sentences as
token sets: a text block holds a template where at least ``CONTAINMENT`` of the template's distinct tokens
occur in it. A block is a run of as many consecutive words as the template has, anywhere in a text, over line
breaks too; a shorter text is one block. Every block that meets the threshold is found:

1. Tokens of all templates are ordered by the number of documents that hold them in the whole corpus, rarest
   first. To share a = ceil(c * |T|) tokens, a block must hold one of the |T| - a + 1 rarest of T: these rows
   (token, template) are the index.
2. One pass over the texts counts words, finds base phrases, and cuts the words around every place of an
   indexed token; it is written without the texts, with a row number.
3. These places meet the index in an equi-join on the token. Each place stands for the blocks in which its
   token is the rarest shared one, so only tokens from its rank on count (positional filter); a place with
   fewer words around it than are needed goes (length filter), then one with too few shared tokens in reach.
   What remains is compared block by block.
4. Labels and the best score are grouped by row number and joined back.

The index has a row a token of a template's prefix; its size depends on the template table alone, which the
driver prepares. The corpus is scanned where it lies: a text of any source and any number of copies costs the
same, and no text crosses an exchange.

Null and empty texts have no words, labels or places; score 0. One output row a row, repeated rows included.
Other columns are ignored. Words fold A-Z only. An empty table gives no rows; without templates only base
phrases count.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import written

CONTAINMENT = 0.8

#: Phrases and labels of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License sentences and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("artistic", "this is free software you may copy or redistribute it under the same terms as perl itself"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("ofl", "this font software is licensed under the sil open font license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("public-domain", "this work has been released into the public domain by its author"),
]

#: Complement of the word pattern on folded text.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_scan(docs: DataFrame, containment: float = CONTAINMENT, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    texts = docs.select("doc_id", folded(F.coalesce("text", F.lit(""))).alias("text"))
    sentences = [(label, text.split()) for label, text in (TEMPLATES if templates is None else templates)]
    order = _frequencies(texts, sorted({t for _, words in sentences for t in words}))
    index = _index(sentences, order, containment)
    seen = written(_look(texts, sorted({r[0] for r in index}), max((r[3] for r in index), default=1)), "license-places")
    held = _held(seen, index)
    out = seen.drop("hits").join(held, "row", "left")
    return out.select(
        *["doc_id", "n_words", "n_base", "first_word", "last_word"],
        F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_list", F.coalesce("held_list", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("held_score", F.lit(0.0))).alias("score"),
    )


def folded(text: Column) -> Column:
    """Lower case as far as words of ASCII letters go: one other character, the Kelvin sign, would become one."""
    return F.lower(F.replace(text, F.lit(chr(0x212A)), F.lit(chr(0x138))))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def _frequencies(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each template token by the documents that hold it, rarest first: a row a token, whatever the corpus."""
    if not vocabulary:
        return {}
    found = texts.select(F.explode(F.array_intersect(F.lit(vocabulary), F.split("text", _GAP))).alias("token"))
    counted = dict(found.groupBy("token").count().collect())
    return {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (counted.get(t, 0), t)))}


def _index(sentences: list[tuple[str, list[str]]], order: dict[str, int], containment: float) -> list[tuple]:
    """(token, template, label, words of a block, tokens needed, all tokens, tokens from this one on) of each prefix token."""
    rows = []
    for i, (label, words) in enumerate(sentences):
        tokens = sorted(set(words), key=order.__getitem__)
        need = math.ceil(containment * len(tokens) - 1e-9)
        rows += [(token, i, label, len(words), need, len(tokens), tokens[k:]) for k, token in enumerate(tokens[: len(tokens) - need + 1])]
    return rows


def _look(texts: DataFrame, prefix: list[str], reach: int) -> DataFrame:
    """Row number, doc_id, word count, base phrases, and the words around every place of a prefix token."""
    cut = texts.withColumn("row", F.monotonically_increasing_id()).withColumn("words", words_of(F.col("text")))
    counted = cut.withColumn("n_words", F.size("words").cast("bigint"))
    places, labels = [], []
    for phrase, label in PHRASES.items():
        said = phrase.split()
        there = F.lit(True)
        for word in said:
            there &= F.contains("text", F.lit(word))
        places.append(F.when(there, F.filter(F.sequence(F.lit(0), F.size("words") - 1), _said(said))).otherwise(F.array().cast("array<int>")))
        labels.append(label)
    found = counted.withColumn("each", F.array(*places)).withColumn("places", F.flatten("each"))

    def around(p: Column) -> Column:
        low = F.greatest(p - (reach - 1), F.lit(0))
        return F.struct(F.get("words", p).alias("token"), (p - low).alias("at"), F.slice("words", low + 1, p - low + reach).alias("around"))

    some = F.arrays_overlap("words", F.lit(prefix)) if prefix else F.lit(False)
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(prefix))
    hits = F.when(some, F.transform(at, around))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(F.get("each", F.lit(k))) > 0, F.lit(x)) for k, x in enumerate(labels)]))))
    return found.select(
        "row",
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        base.alias("base_list"),
        hits.alias("hits"),
    )


def _said(said: list[str]) -> Callable[[Column], Column]:
    """Whether the words from a place on are these."""

    def at(i: Column) -> Column:
        same = F.get("words", i) == said[0]
        for k, word in enumerate(said[1:], 1):
            same &= F.coalesce(F.get("words", i + k) == word, F.lit(False))
        return same

    return at


def _held(seen: DataFrame, index: list[tuple]) -> DataFrame:
    """row, held_list and held_score: the templates that some block of a row holds, and the best share."""
    schema = "token string, template int, label string, size int, need int, n_tokens int, rest array<string>"
    table = seen.sparkSession.createDataFrame(index, schema)
    hits = seen.where("size(hits) > 0").select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    met = hits.join(table, "token").where((F.size("around") >= F.col("need")) & (F.size("rest") >= F.col("need")))
    met = met.where(F.size(F.array_intersect("rest", "around")) >= F.col("need"))
    low = F.greatest(F.col("at") - F.col("size") + 1, F.lit(0))
    high = F.greatest(F.least(F.col("at"), F.size("around") - F.col("size")), low)
    shared = F.array_max(F.transform(F.sequence(low, high), lambda i: F.size(F.array_intersect("rest", F.slice("around", i + 1, F.col("size"))))))
    best = met.withColumn("shared", shared).where("shared >= need")
    return best.groupBy("row").agg(F.collect_set("label").alias("held_list"), F.max(F.col("shared") / F.col("n_tokens")).alias("held_score"))


def template_sql() -> str:
    """The templates as rows for the brute-force SQL."""
    rows = [f"({i}, '{label}', {len(text.split())}, [{', '.join(repr(t) for t in sorted(set(text.split())))}])" for i, (label, text) in enumerate(TEMPLATES)]
    return "(VALUES " + ", ".join(rows) + ") AS t(template, label, size, tokens)"


def oracle_sql(containment: float = CONTAINMENT) -> str:
    """Every run of words that starts with a template's token, against every template."""
    phrases = " UNION ALL ".join(f"SELECT {[*p.split()]} AS phrase, '{label}' AS label" for p, label in PHRASES.items())
    return rf"""
WITH docs AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
phrases AS ({phrases}),
places AS (
  SELECT doc_id, label, p - 1 AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs), phrases
  WHERE list_slice(w, p, p + len(phrase) - 1) = phrase),
base AS (
  SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word,
         list_sort(list_distinct(list(label))) AS base_list FROM places GROUP BY doc_id),
templates AS (SELECT template, label, size, len(tokens) AS n_tokens, unnest(tokens) AS token FROM {template_sql()}),
each_word AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS p FROM docs),
found AS (SELECT doc_id, p, token, template, label, size, n_tokens FROM each_word JOIN templates USING (token)),
blocks AS (
  SELECT a.doc_id, a.label, a.template, a.n_tokens, a.p, count(DISTINCT b.token) AS shared
  FROM found a JOIN found b ON a.doc_id = b.doc_id AND a.template = b.template AND b.p BETWEEN a.p AND a.p + a.size - 1
  GROUP BY ALL),
held AS (
  SELECT doc_id, list(DISTINCT label) AS held_list, max(shared / n_tokens) AS s
  FROM blocks WHERE shared >= {containment} * n_tokens - 1e-9 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base_list, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []), coalesce(held_list, [])))), ','), '') AS labels,
       CAST(CASE WHEN coalesce(n_base, 0) > 0 THEN 1 ELSE coalesce(s, 0) END AS DOUBLE) AS score
FROM docs d LEFT JOIN base b ON d.doc_id = b.doc_id LEFT JOIN held t ON d.doc_id = t.doc_id
"""
