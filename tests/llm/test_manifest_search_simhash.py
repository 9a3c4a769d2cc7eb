"""SimHash near-dedup, the Merkle manifest and ranked search against brute force, and on their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("spanloom.llm.queries")

from pyspark.sql.functions import lit  # noqa: E402

from spanloom.llm.common import new_path  # noqa: E402
from spanloom.llm.language import document_records, fit, identify  # noqa: E402
from spanloom.llm.lexical_search import search  # noqa: E402
from spanloom.llm.merkle import addresses, manifest, proofs  # noqa: E402
from spanloom.llm.simhash_dedup import near, simhash, simhash_dedup  # noqa: E402
from spanloom.llm.token_files import read_tokens, write_tokens  # noqa: E402
from tests.llm.test_operators import SCHEMA, corpus, frame, library  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_simhash(text):
    from xxhash import xxh64_intdigest

    w = WORD.findall((text or "").translate(FOLD))
    shingles = [" ".join(w[p : p + 3]) for p in range(max(len(w) - 2, 1))] if w else []
    h = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(links, nodes):
    label = {x: x for x in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


def test_simhash_by_words():
    texts = [*(t or "" for _, t, *_ in corpus(3)), "x", "x y", "Ünïcode ÀB A b c d", "a b " * 40_000]
    assert simhash(pa.array(texts)).tolist() == [one_simhash(t) for t in texts]


@pytest.mark.parametrize(("tile", "run"), [(1 << 15, 256), (7, 3)])
def test_near_finds_all_links(spark, tile, run):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(150)]
    for x in list(fps):
        for _ in range(r.randrange(4)):
            fps.append(x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    fps += [0, 1, 3, 7, (1 << 64) - 1, (1 << 64) - 2]
    family = r.getrandbits(64)
    fps += [family ^ (1 << b) for b in range(64)]
    fps = sorted({np.array([x], np.uint64).view(np.int64)[0].item() for x in fps})
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    links = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if apart(a, b) <= 3]
    stars = [tuple(x) for x in near(spark.createDataFrame([(x,) for x in fps], "fp bigint"), tile=tile, run=run).collect()]
    assert components(stars, fps) == components(links, fps) and len(links) > 100
    assert len(stars) < 25 * len(fps) * (1 if tile > 100 else 20)


def test_simhash_dedup(spark):
    rows = [r for r in corpus(8) if r[0] != 2] + [(900, "a b c d", "en", "s", 7), (900, "q", "en", "s", 1), (None, "Q", "en", "s", 1), (901, "A b c\td", "en", "s", 7), (None, "only here", "en", "s", 9)]
    docs = frame(spark, rows).withColumn("fp", lit("x")).withColumn("Component_ID", lit(1))
    got = simhash_dedup(docs).collect()
    fps = [one_simhash(t) for _, t, *_ in rows]
    nodes = [*range(len(rows))]
    links = [(a, b) for a in nodes for b in nodes if a < b and ((fps[a] ^ fps[b]).bit_count() <= 3 or rows[a][0] is not None and rows[a][0] == rows[b][0])]
    label = components(links, nodes)
    least = {}
    for k in nodes:
        if rows[k][0] is not None:
            least[label[k]] = min(least.get(label[k], 1 << 62), rows[k][0])
    key = lambda x: str(x)
    want = [(rows[k][0], f"{fps[k]:016x}", least.get(label[k]), rows[k][0] is None or rows[k][0] == least[label[k]]) for k in nodes]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert simhash_dedup(docs.limit(0)).collect() == []


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    fields = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def grown(level):
    while True:
        yield level
        if len(level) == 1:
            return
        level = [digest("".join(level[k : k + 2])) for k in range(0, len(level), 2)]


def plain_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs]
    trees = [list(grown([leaf(r) for r in g])) for g in groups]
    top = list(grown([t[-1][0] for t in trees]))
    out = []
    for tree, (group, levels) in enumerate(zip(groups, trees, strict=True)):
        for i, row in enumerate(group):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None
            at, node, met = i, leaf(row, 1) if tampered else leaf(row), []
            for steps, at in ((levels, i), (top, tree)):
                for level in steps[:-1]:
                    other = level[at ^ 1] if (at ^ 1) < len(level) else ""
                    node = digest(other + node if at & 1 else node + other)
                    met.append(other)
                    at >>= 1
            out.append((row[0], leaf(row), levels[-1][0], top[-1][0], digest("".join(met)), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize(("levels", "each"), [(10, 16_384), (2, 20), (1, 7)])
def test_merkle_proofs(spark, levels, each):
    rows = [(i, t, ["en", "de", None, "zu", ""][i % 11 % 5], "s" if i % 4 else None, n) for i, t, _, _, n in corpus(9)]
    rows += [(None, "x", "one", None, None), (None, "y", "en", None, 3), (7, None, None, None, 2**63 - 1), (14, "z", "é", "s", 2**63 - 1), rows[3], rows[3]]
    docs = frame(spark, rows).withColumn("key", lit("x")).withColumn("IDX", lit(1))
    made = manifest(docs, levels=levels, leaves_a_part=each)
    got = sorted(map(tuple, proofs(made).collect()), key=str)
    want = sorted(plain_manifest(rows), key=str)
    assert got == want and {x[-1] for x in got} == {True, False}
    assert [x["root"] for x in made.root().collect()] == [want[0][3]]


def test_merkle_of_nothing_and_of_one(spark):
    docs = frame(spark, [(1, "a", None, None, 1)])
    [only] = proofs(manifest(docs)).collect()
    assert only["leaf"] == only["subroot"] == only["root"] == leaf((1, "a", None, None, 1)) and only["proof_sha256"] == digest("")
    empty = manifest(docs.limit(0))
    assert proofs(empty).collect() == [] and empty.root().collect() == []


def test_layout_halves_the_height():
    for height in range(9):
        at = addresses(height)
        assert sorted(np.concatenate(at).tolist()) == list(range((2 << height) - 1))
    at = addresses(3)  # four levels: the upper two, then four lower trees of two levels
    assert [x.tolist() for x in at[:2]] == [[0], [1, 2]] and at[2].tolist() == [3, 6, 9, 12] and at[3].tolist() == [4, 5, 7, 8, 10, 11, 13, 14]


def plain_search(rows, items, top=10):
    words = [TERM.findall((r[1] or "").translate(FOLD)) for r in rows]
    n_docs, length = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    asked = {}
    for i, text in items:
        asked.setdefault(i, Counter()).update(TERM.findall((text or "").translate(FOLD)))
    out = []
    for i, terms in asked.items():
        scored = []
        for row, w in zip(rows, words, strict=True):
            held, m = Counter(w), 25 + 75 * len(w) * n_docs // length
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * held[t] // (1000 * held[t] + 8 * m)) for t, n in terms.items() if held[t])
            if score > 0:
                scored.append((-score, row[0] is None, row[0] or 0))
        out += [(i, k + 1, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize(("postings", "item_bytes"), [(200_000, 4 << 20), (40, 150)])
def test_search(spark, postings, item_bytes):
    r = random.Random(4)
    rows = [*corpus(6, 90), (None, "w1 w2 w3", "en", "s", 8), (None, "w1", "en", "s", 2), (300, "w1", "en", "s", 2), (299, "w1", "en", "s", 2)]
    items = [(k, " ".join(f"W{r.randrange(400)}" for _ in range(r.choice([1, 4, 30])))) for k in range(20)]
    items += [(20, "w1 w1-w1"), (21, None), (22, ""), (23, "absent"), (None, "w2 naïve ñ"), (5, "w9")]
    benchmark = spark.createDataFrame([(*x, "b") for x in items], "item_id bigint, text string, score string")
    got = search(frame(spark, rows).withColumn("terms", lit("x")), benchmark, postings=postings, item_bytes=item_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_search(rows, items), key=str)


def test_search_of_nothing(spark):
    docs, items = frame(spark, [(1, "a", "en", "s", 1), (2, None, "en", "s", 0)]), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert search(docs.limit(0), items).collect() == [] and search(docs, items.limit(0)).collect() == [] and search(docs.where("doc_id = 2"), items).collect() == []
    [only] = search(docs, items).collect()
    assert tuple(only) == (1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 800)))


def test_token_files_keep_the_largest_id_apart_from_null(spark):
    rows = [(2**63 - 1, "a b"), (None, "c"), (-5, "d e f"), (None, None), (0, "g"), (2**63 - 1, "h")]
    path = new_path(spark, "tokens")
    write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("missing", lit(1)).withColumn("Key", lit("x")), path)
    got = read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [-5, 0, 2**63 - 1, 2**63 - 1, None, None]
    assert sorted(r["ids"] for r in got) == sorted(library(2)(t) for _, t in rows)
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]


def test_language_keeps_columns_of_any_name(spark):
    words = {"en": "the house and the garden with water", "de": "das haus und der garten mit wasser"}
    docs = spark.createDataFrame([(i, words[["en", "de"][i % 2]], ["en", "de"][i % 2], "h.org", 0) for i in range(12)], SCHEMA)
    names = ["language_top", "Language_Letters", "language_sum", "language_top_", "_loglik", "language_host"]
    rows = document_records(docs)
    for k, c in enumerate(names):
        rows = rows.withColumn(c, lit(f"v{k}"))
    rows = rows.withColumn("language", lit("old"))
    plain = {r["doc_id"]: (r["language"], r["language_kept"]) for r in identify(document_records(docs), fit(docs)).collect()}
    out = identify(rows, fit(docs))
    assert out.columns == ["doc_id", "declared", "host", "suffix", *names, "language", "language_posterior", "language_kept"]
    got = out.collect()
    assert all([r[c] for c in names] == [f"v{k}" for k in range(len(names))] for r in got) and {r["doc_id"]: (r["language"], r["language_kept"]) for r in got} == plain
    assert identify(rows, fit(docs.limit(0))).columns == out.columns
