"""The corpus operators against brute force, and on nulls, empties, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("spanloom.llm.queries")

from pyspark.sql.functions import lit  # noqa: E402

from spanloom.llm import fingerprints, token_counts  # noqa: E402
from spanloom.llm.common import new_path  # noqa: E402
from spanloom.llm import decontaminate as decontaminate_module  # noqa: E402
from spanloom.llm.decontaminate import align, decontaminate, leaks  # noqa: E402
from spanloom.llm.fingerprints import FRACTION, compare_with_next, likeness, merged, read_in, sketches  # noqa: E402
from spanloom.llm.grams import mix, shingle_sets, words  # noqa: E402
from spanloom.llm.language import fit, identify, trigrams  # noqa: E402
from spanloom.llm.licenses import PHRASES, TEMPLATES, license_scan  # noqa: E402
from spanloom.llm.line_dedup import line_dedup  # noqa: E402
from spanloom.llm.minhash_dedup import minhash_dedup  # noqa: E402
from spanloom.llm.packing import pack, plan  # noqa: E402
from spanloom.llm.substring_dedup import substring_dedup  # noqa: E402
from spanloom.llm.token_files import decode_file, encode_file, read_tokens, write_tokens  # noqa: E402
from spanloom.llm.tokens import Encoder, vocabulary_path  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed=0, n=60):
    """Random texts with copies, near copies, shared passages, empties, a null and a repeated row."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Über", "naïve.", "ñ", "x,y"]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = text(30)
    texts = [text(r.choice([1, 3, 12, 13, 40, 120])) for _ in range(n)]
    for i in range(0, n, 7):
        texts[i] = texts[i] + "\n" + shared + "\t" + text(5)
    for i in range(3, n, 9):
        own = WORD.findall(texts[i - 1])
        if len(own) > 30:
            own[r.randrange(len(own))] = "changed"
        texts[i] = " ".join(own)
    texts[5] = texts[4]
    texts += ["", None, "  ", "a b c", "A B C"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[2]]


def library(end_id):
    """Ids by the tokenizers library alone, as bytes, with the end id."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path(None))
    return lambda text: np.array([*plain.encode(text or "", add_special_tokens=False).ids, end_id], "<u4").tobytes()


#: Texts with added tokens beside blanks, uneven blanks, other scripts and long words.
ODD = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>  y<|endoftext|>z ", "<|endoftext", " a", "a ", "  ", "a \nb", "a\nb\n\nc d\n", "it's 'tis they'll", "x1y22 333", "z" * 5000, "日本語 ¤x 😀", "a\u00a0 b", "tab\t x"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_substring_dedup(spark):
    rows = corpus()
    found = {(i, k): WORD.findall(t or "") for k, (i, t, *_) in enumerate(rows)}
    first = {}
    for (i, _), w in found.items():
        for p in range(len(w) - 12):
            g = tuple(w[p : p + 13])
            first[g] = min(first.get(g, i), i)
    want = []
    for (i, _), w in found.items():
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r)[:4] for r in substring_dedup(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd", "en", "s", 7), (2, "x\na\nb\nc\ny", "en", "s", 9), (3, "a\na\na\na", "en", "s", 7), (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, "a\nb", "en", "s", 3), (7, "\n\n\n", "en", "s", 3), (8, "a\nb\nc", "en", "s", 5)]
    got = {r["doc_id"]: (r["text"], r["line_dedup_removed"]) for r in line_dedup(frame(spark, rows)).collect()}
    assert got[1] == ("a\nb\nc\nd", 0) and got[2] == ("x\ny", 3) and got[3] == ("a", 3) and got[4] == (None, 0)
    assert got[5] == ("", 0) and got[6] == ("a\nb", 0) and got[7] == ("\n\n\n", 0) and got[8] == ("", 3)


def test_line_dedup_of_rows_that_share_an_id(spark):
    for k in (2, None):
        rows = [(1, "a\nb\nc"), (k, "a\nb\nc\nz"), (k, "u1\nu2\nu3\nu4"), (k, "u1\nu2\nu3\nu4")]
        docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id bigint, text string, at_doc int, line_dedup_ranges string")
        got = line_dedup(docs)
        assert got.columns == [*docs.columns, "line_dedup_lines", "line_dedup_removed"]
        assert sorted(r["text"] for r in got.collect()) == ["a\nb\nc", "u1\nu2\nu3\nu4", "u1\nu2\nu3\nu4", "z"]
        assert {(r["at_doc"], r["line_dedup_ranges"]) for r in got.collect()} == {(7, "x")}


def test_line_dedup_by_brute_force(spark):
    r = random.Random(21)
    texts = ["\n".join(r.choice(["a", "b", "c", "", " ", "d"]) for _ in range(r.randint(0, 9))) for _ in range(60)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            if "".join(window).strip():
                if window in seen:
                    gone |= {p, p + 1, p + 2}
                seen.add(window)
        want[i] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone))
    got = {x["doc_id"]: (x["text"], x["line_dedup_removed"]) for x in line_dedup(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    assert got == want


def test_minhash_dedup_of_rows_that_share_an_id(spark):
    x, y, z = (" ".join(f"{k}{i}" for i in range(30)) for k in "xyz")
    rows = [(1, x), (5, x), (5, y), (7, y), (8, z), (None, z), (None, None)]
    got = minhash_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (8, 8, True)]


def test_minhash_dedup(spark):
    rows = corpus(1, 90)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(fold))
        sets[i] = {tuple(w[p : p + 4]) for p in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = minhash_dedup(frame(spark, rows), shingle=4).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == find(r["doc_id"]) and r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert any(not r["kept"] for r in got)


def test_large_star(spark):
    base = " ".join(f"b{i}" for i in range(200)).split()
    rows = []
    for i in range(450):
        own = list(base)
        own[i % 200] = f"e{i}"
        rows.append((i, " ".join(own), "en", "s", 0))
    assert {r["component_id"] for r in minhash_dedup(frame(spark, rows)).collect()} == {0}


def test_links_that_no_star_shows(spark):
    """Chains: neighbours in a chain are near, its ends are not, so that one centre a bucket does not suffice."""
    base = [f"b{i}" for i in range(300)]
    rows = []
    for chain in range(6):
        own = [f"c{chain}-{i}" if i < 30 else x for i, x in enumerate(base)]
        for step in range(12):
            for i in range(4):
                own[40 + 20 * step + 5 * i] = f"e{chain}-{step}-{i}"
            rows.append((100 * chain + step, " ".join(own), "en", "s", 0))
    random.Random(2).shuffle(rows)
    sets = {i: {tuple(t.split()[p : p + 5]) for p in range(296)} for i, t, *_ in rows}
    label = {i: i for i in sets}
    while True:
        after = {a: min(label[b] for b in sets if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])) for a in sets}
        if after == label:
            break
        label = after
    assert len(set(label.values())) < len(label)
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup(frame(spark, rows)).collect()} == label


def test_link_inside_a_large_bucket(spark):
    """One near pair among many documents on one template that are all just under the threshold to each other."""
    rows = []
    for i in range(120):
        own = [f"b{k}" for k in range(200)]
        for k in range(24):
            own[8 * k + 4] = f"e{i}-{k}" if k >= 10 or i not in (50, 80) else f"pair-{k}"
        rows.append((i, " ".join(own), "en", "s", 0))
    sets = {i: set(t.split()) for i, t, *_ in rows}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sets, 2)}
    assert [p for p, x in like.items() if x >= 0.8] == [(50, 80)]
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup(frame(spark, rows), shingle=1, bins=2, rows=1).collect()}
    assert got == {i: 50 if i == 80 else i for i in sets}


def test_leaks_beside_other_blanks(spark):
    """Words end at ASCII blanks alone; no-break spaces and separators before a passage do not shift it."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    item = " ".join(word() for _ in range(30))
    odd = " ".join(f"{word()}\u00a0{word()}\x1f{word()}\u3000{word()}" for _ in range(60))
    docs = frame(spark, [(1, f"{odd} {item} {odd}", "en", "s", 0)])
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    for limit in (0, 1000):
        assert [(x["doc_id"], x["score"], x["at_word"]) for x in leaks(docs, items, broadcast_seeds=limit).collect()] == [(1, 1.0, 89)]


def test_leaks(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(30)]
    edited = [w if i % 6 else word() for i, w in enumerate(item)]
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [(1, f"{noise(50)} {' '.join(item)} {noise(9)}", "en", "s", 0), (2, f"{noise(20)} {' '.join(edited).upper()} {noise(30)}", "en", "s", 0), (3, noise(200), "en", "s", 0), (4, None, "en", "s", 0), (5, "", "en", "s", 0)]
    items = spark.createDataFrame([(7, " ".join(item)), (8, noise(25)), (9, "two words"), (10, None)], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in leaks(frame(spark, docs), items).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7] == 1.0
    joined = {(x["doc_id"], x["item_id"]): x["score"] for x in leaks(frame(spark, docs), items, broadcast_seeds=0).collect()}
    assert joined == got


def test_leaks_of_edited_copies(spark):
    """Most trigrams of an edited copy occur nowhere; the few that survive the edits find it."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(30)]
    noise = lambda n: " ".join(word() for _ in range(n))
    replaced = " ".join(w if i % 4 else word() for i, w in enumerate(item))
    deleted = " ".join(w for i, w in enumerate(item) if i % 4)
    items = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    for edited in (replaced, deleted):
        docs = frame(spark, [(1, f"{noise(40)} {edited} {noise(40)}", "en", "s", 0), (2, noise(100), "en", "s", 0)])
        for limit in (0, 1000):
            got = leaks(docs, items, broadcast_seeds=limit).collect()
            assert [x["doc_id"] for x in got] == [1] and got[0]["score"] >= 0.5


def test_leaks_of_rows_that_share_an_id(spark):
    r = random.Random(15)
    item = " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(20))
    docs = spark.createDataFrame([(3, item), (3, item + " x"), (3, item), (None, item), (None, "y " + item), (4, "z")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (7, item)], "item_id bigint, text string")
    ways = [sorted(map(tuple, leaks(docs, items, broadcast_seeds=n).collect()), key=str) for n in (0, 1000)]
    assert ways[0] == ways[1] == [(3, 7, 1.0, 18, 19), (None, 7, 1.0, 18, 19)]
    assert [tuple(x) for x in decontaminate(docs, items).collect()] == [(4, "z")]


def test_leaks_against_all_pairs(spark):
    """Every pair that aligns at the threshold and keeps three words in a row is found."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcd") for _ in range(2))
    items = {i: [word() for _ in range(r.randint(8, 25))] for i in range(12)}
    docs = {}
    for i in range(60):
        own = [x if r.random() > 0.25 else word() for x in r.choice(list(items.values()))]
        docs[i] = [word() for _ in range(r.randint(0, 30))] + own + [word() for _ in range(r.randint(0, 30))]
    want = set()
    for i, d in docs.items():
        for k, item in items.items():
            threes = {tuple(item[p : p + 3]) for p in range(len(item) - 2)}
            if align(item, d)[0] >= 0.5 and any(tuple(d[p : p + 3]) in threes for p in range(len(d) - 2)):
                want.add((i, k))
    got = leaks(frame(spark, [(i, " ".join(d), "en", "s", 0) for i, d in docs.items()]), spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id bigint, text string")).collect()
    found = {(x["doc_id"], x["item_id"]) for x in got}
    assert found <= want and len(found) >= 0.98 * len(want) and len(want) > 40


def test_common_seeds_stand_back(spark):
    """A common trigram finds nothing alone, but with a fourth word; what is copied everywhere keeps its seeds."""
    r = random.Random(23)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    dull, item, copied = [word() for _ in range(3)], [word() for _ in range(9)], [word() for _ in range(12)]
    item[3:6] = dull
    survivors = [w if 3 <= i < 8 else word() for i, w in enumerate(item)]  # five words in a row, of which three are common
    rows = [(i, " ".join([word(), *dull, word()])) for i in range(40)] + [(50, " ".join(item)), (51, " ".join(survivors)), (52, " ".join(copied[:5] + [word(), word()] + copied[7:]))] + [(60 + i, " ".join(copied)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(copied))], "item_id bigint, text string")
    planted = {(x["item_id"], x["item_at"], x["size"]) for x in decontaminate_module.seeds(docs, items, common=4).collect()}
    assert {x for x in planted if x[0] == 1} == {(1, at, 3) for at in range(7) if at != 3} | {(1, 2, 4), (1, 3, 4)}
    assert {x for x in planted if x[0] == 2} == {(2, at, 3) for at in range(10)}
    for limit in (0, 1000):
        got = {(x["doc_id"], x["item_id"]) for x in leaks(docs, items, broadcast_seeds=limit, common=4).collect()}
        assert got == {(50, 1), (51, 1), (52, 2)} | {(60 + i, 2) for i in range(30)}


def test_alignment_is_smith_waterman():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(1, 12))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert align(a, b)[0] == max(map(max, h)) / (2 * len(a))


def test_fingerprints(spark):
    rows = [x for x in corpus(5, 40)]
    got = {}
    for r in compare_with_next(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    order = sorted(rows, key=lambda x: (x[0], x[1] or ""))
    assert sum(map(len, got.values())) == len(rows)
    for here, after in zip(order, [*order[1:], order[0]], strict=True):
        text, next_text = here[1] or "", after[1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + next_text[:k]
        own, changed, following = (sketches([x])[0] for x in (text, edited, next_text))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        assert any(r["edited_sha256"] == digest and r["n_chars"] == len(text) and r["near_edited"] == likeness(own, changed) and r["near_next"] == likeness(own, following) and np.array_equal(read_in(r["fingerprint"]), own) for r in got[here[0]])


def test_sketch_is_that_of_each_shingle_alone():
    text = " ".join(f"W{i % 37}" for i in range(90))
    own = text.lower().split()
    alone = {int(mix(shingle_sets(words(pa.array([" ".join(own[p : p + 5])])), 5)[1], 23)[0]) for p in range(len(own) - 4)}
    assert set(sketches([text])[0].tolist()) == {h for h in alone if h < (1 << 64) // FRACTION} | {min(alone)}


def test_fingerprints_in_many_ranges(spark, monkeypatch):
    """Ranges at quantiles, an outlying doc_id, repeated and null doc_ids."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 200)
    r = random.Random(22)
    text = lambda: " ".join(r.choice("abcdefg") for _ in range(r.randint(0, 40)))
    rows = [(i, text()) for i in range(80)] + [(10**17, text()), (-(10**15), text()), (7, text()), (7, text())]
    nulls = [(None, text()) for _ in range(40)]
    got = compare_with_next(spark.createDataFrame(rows + nulls, "doc_id bigint, text string")).collect()
    order = sorted(rows)
    assert len(got) == len(rows) + len(nulls) and sum(x["doc_id"] is None for x in got) == len(nulls)
    found = {(x["doc_id"], x["n_chars"], x["edited_sha256"]) for x in got}
    for (i, here), (_, after) in zip(order, order[1:], strict=False):
        k = len(here) // 4
        assert (i, len(here), hashlib.sha256((here[: len(here) - k] + after[:k]).encode()).hexdigest()) in found


def test_sketches_merge():
    a, b = " ".join(f"a{i}" for i in range(900)), " ".join(f"b{i}" for i in range(400))
    one, two, both = sketches([a, b, f"{a} {b}"])
    assert len(np.setxor1d(merged(one, two), both)) <= 4  # the shingles across the seam
    assert likeness(two, both) > 0.95 and likeness(one, two) == 0.0


def test_language(spark):
    r = random.Random(6)
    sounds = {"en": "the and thing with of er", "fr": "les éau queux dans le oi", "de": "der und schön für ßen ich"}
    text = lambda k: " ".join("".join(r.choice(sounds[k].split()) for _ in range(2)) for _ in range(30))
    rows = [(i, text(k), k, "s", 0) for i, k in enumerate(list(sounds) * 30)]
    model = fit(frame(spark, rows))
    held = [(100 + i, text(k), k) for i, k in enumerate(list(sounds) * 10)] + [(200, None, None), (201, "", None), (202, "123 456", None)]
    df = spark.createDataFrame([(i, t, None, "h.example", None, k) for i, t, k in held], "doc_id bigint, text string, declared string, host string, suffix string, truth string")
    got = {x["doc_id"]: x for x in identify(df, model).collect()}
    assert all(got[i]["language"] == k and got[i]["language_kept"] for i, _, k in held if k)
    assert all(got[i]["language"] is None and not got[i]["language_kept"] for i in (200, 201, 202))
    # a declared language and a host decide where the text hardly speaks
    short = spark.createDataFrame([(i, text("fr"), "fr", "fr.example", "fr", "fr") for i in range(60)] + [(900, "zz", "fr", "fr.example", "fr", "fr")], df.schema)
    assert [x["language"] for x in identify(short, model).collect() if x["doc_id"] == 900] == ["fr"]


def test_many_languages_and_subtags(spark):
    r = random.Random(16)
    sounds = {f"{a}{b}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)] for a in "abcdefg" for b in "abcdefghij"}
    text = lambda k: " ".join("".join(r.choice(sounds[k]) for _ in range(2)) for _ in range(30))
    tags = [f"{k}{tail}" for k in sounds for tail in ("", "-US", "_gb")]
    model = fit(frame(spark, [(i, text(k[:2]), k, "s", 0) for i, k in enumerate(tags)]))
    assert model[0] == sorted(sounds)
    df = spark.createDataFrame([(i, text(k), None, None, None, k) for i, k in enumerate(sounds)], "doc_id bigint, text string, declared string, host string, suffix string, truth string")
    assert all(x["language"] == x["truth"] and x["language_kept"] for x in identify(df, model).collect())


def test_priors_are_smoothed_sums(spark):
    """The host prior of each row by a plain loop over the text posteriors."""
    r = random.Random(23)
    sounds = {"en": "the and thing with of er", "fr": "les queux dans le oi en", "de": "der und schon fur ich er"}
    text = lambda k, n: " ".join(r.choice(sounds[k].split()) for _ in range(n))
    languages = list(sounds)
    model = fit(frame(spark, [(i, text(k, 20), k, "s", 0) for i, k in enumerate(languages * 20)]))
    hosts = ["a.x.org", "b.x.org", "y.net", None]
    rows = [(i, text(r.choice(languages), r.randint(1, 6)), r.choice(hosts)) for i in range(120)]
    df = spark.createDataFrame([(i, t, None, h, None) for i, t, h in rows], "doc_id bigint, text string, declared string, host string, suffix string")
    got = {x["doc_id"]: x for x in identify(df, model).collect()}
    ids, logs = model[0], model[1].astype(float)
    logliks, posterior = {}, {}
    for i, t, _ in rows:
        owner, cell = trigrams(pa.array([t]))
        mean = logs[:, cell].mean(axis=1) * min(len(cell), 40)
        logliks[i] = mean
        e = np.exp(mean - mean.max())
        posterior[i] = e / e.sum()
    every = sum(posterior.values())
    base = (every + 1) / (every.sum() + len(ids))
    for i, _, h in rows:
        if h is None:
            prior = base
        else:
            own = sum(posterior[k] for k, _, x in rows if x == h)
            domain = sum(posterior[k] for k, _, x in rows if x and x.split(".")[-2:] == h.split(".")[-2:])
            over = (domain + 50 * base) / (domain.sum() + 50)
            prior = (own + 20 * over) / (own.sum() + 20)
        total = logliks[i] + np.log(prior)
        e = np.exp(total - total.max())
        assert got[i]["language"] == ids[int(total.argmax())] and math.isclose(got[i]["language_posterior"], float((e / e.sum()).max()), rel_tol=1e-6)


def test_language_columns_that_clash(spark):
    rows = [(i, "the thing and the other", "en", "x", i) for i in range(4)]
    model = fit(frame(spark, rows))
    df = spark.createDataFrame([(1, "the thing", "h", "old", 5)], "doc_id bigint, text string, host string, language string, language_top int").withColumns({"declared": lit(None).cast("string"), "suffix": lit(None).cast("string")})
    for m in (model, ([], None)):
        out = identify(df, m)
        assert sorted(out.columns) == sorted(["doc_id", "host", "declared", "suffix", "language_top", "language", "language_posterior", "language_kept"]) and out.count() == 1


def test_long_chunks_hold_few_places(monkeypatch):
    import public_tokenizers

    counter = token_counts.Counter(token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    chunk = "".join(random.Random(25).choice("abcdeé日") for _ in range(4000))
    whole = counter.pieces(chunk)
    monkeypatch.setattr(token_counts, "HELD", counter.longest + 10)
    assert counter.pieces(chunk) == whole


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    exact = Tokenizer(models.Unigram(pieces, 0, True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = [t for _, t, *_ in corpus(7)] + ["日本語 ¤x", "x" * 3000, "<0x0A> <s>", "\n\n a\tb", "▁▁ q"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame(spark, rows)).collect()}
    assert got == {i: len(exact.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_licenses(spark):
    rows = [(1, "Licensed under CC  BY-NC 4.0.\nall rights-reserved", "en", "s", 0), (2, "acc by and cc bye", "en", "s", 0), (3, None, "en", "s", 0), (4, "Released under the MIT License.", "en", "s", 0), (5, "é ALL RIGHTS\nRESERVED x GNU General Public License", "en", "s", 0)]
    got = {r["doc_id"]: r for r in license_scan(frame(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 2, 7, "cc-by,reserved") and "cc-by-nc" in got[1]["labels"]
    assert got[2]["n_base"] == 0 and got[2]["first_word"] is None and got[2]["labels"] == "" and got[2]["score"] == 0
    assert got[3]["n_words"] == 0 and got[4]["labels"] == "mit" and got[4]["score"] == 1.0
    assert (got[5]["first_word"], got[5]["last_word"], got[5]["n_words"]) == (1, 6, 9)


def test_wrapped_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    narrow = "x y\n" + "\n * \n * ".join(mit.split()) + "\nz"
    apart = mit.replace("\n", "\n" + "other " * 25 + "\n")
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([mit, bsd, narrow, apart])]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan(frame(spark, rows)).collect()}
    assert got == {0: ("mit", 1.0), 1: ("bsd", 1.0), 2: ("mit", 1.0), 3: ("", 0.0)}


def test_licenses_by_brute_force(spark):
    r = random.Random(24)
    vocabulary = ["license", "the", "under", "of", "MIT", "gnu", "Public", "noise", "copy", "this", "is", "Kelvin\u212a"]
    texts = []
    for _ in range(80):
        own = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))).split()
        words_of = r.choice(TEMPLATES)[1].split()
        part = [x for x in words_of if r.random() > r.choice([0, 0.1, 0.2, 0.3])]
        texts.append(r.choice([" ", "\n", ", "]).join([*own[:5], *part, *own[5:]]))
    got = {x["doc_id"]: x for x in license_scan(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    some = 0
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(fold))
        labels, best = set(), 0.0
        for label, sentence in TEMPLATES:
            tokens, n = set(sentence.split()), len(sentence.split())
            share = max((len(tokens & set(w[p : p + n])) / len(tokens) for p in range(max(1, len(w) - n + 1))), default=0)
            if share >= 0.8:
                labels.add(label)
                best = max(best, share)
        base = [(p, label) for phrase, label in PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        labels |= {x for _, x in base}
        some += bool(labels)
        assert (got[i]["labels"], got[i]["n_words"], got[i]["n_base"]) == (",".join(sorted(labels)), len(w), len(base)) and math.isclose(got[i]["score"], 1.0 if base else best)
    assert 20 < some < 80
    assert license_scan(frame(spark, [(1, "all rights reserved by mit license", "en", "s", 0)]), templates=[]).first()["labels"] == "reserved"


def test_packing(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "Γάμμα", "delta."]) for _ in range(r.choice([0, 5, 700, 1500, 4000]))), "en", "s", 0) for i in range(60)] + [(60, None, "en", "s", 0)] + [(61 + i, x, "en", "s", 0) for i, x in enumerate(ODD)]
    encode = library(0)
    got = {}
    for x in pack(frame(spark, rows)).collect():
        got.setdefault(x["doc_id"], []).append(x)
    used = {}
    for i, t, *_ in rows:
        ids = encode(t)
        pieces = sorted(got[i], key=lambda x: x["piece"])
        assert [p["start"] for p in pieces] == list(np.cumsum([0, *[p["length"] for p in pieces]])[:-1]) and sum(p["length"] for p in pieces) == len(ids) // 4
        assert all(p["length"] == 2048 for p in pieces[1:]) and all(p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])]) for p in pieces)
        for p in pieces:
            used.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    total = 0
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    # no better than first-fit-decreasing over all pieces one by one
    rooms = []
    for size in sorted((p["length"] for pieces in got.values() for p in pieces), reverse=True):
        k = next((k for k, room in enumerate(rooms) if room >= size), None)
        if k is None:
            rooms.append(2048 - size)
        else:
            rooms[k] -= size
    assert math.ceil(total / 2048) <= len(used) <= len(rooms)


def test_plan_is_exact():
    r = random.Random(9)
    for _ in range(50):
        histogram = {r.randint(1, 64): r.randint(1, 30) for _ in range(r.randint(1, 20))}
        fill, seen = {}, dict.fromkeys(histogram, 0)
        for length, rank, n, first, offset in plan(histogram, 64):
            assert rank == seen[length]
            seen[length] += n
            for q in range(first, first + n):
                assert fill.get(q, 0) == offset
                fill[q] = offset + length
                assert fill[q] <= 64
        assert seen == histogram


def test_token_files(spark):
    rows = corpus(10) + [(1000 + i, x, "en", "s", 0) for i, x in enumerate(ODD)]
    path = new_path(spark, "tokens")
    write_tokens(frame(spark, rows), path)
    encode, start, want = library(2), 0, []
    for i, t, *_ in sorted(rows, key=lambda x: (x[0], x[1] or "")):
        ids = encode(t)
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_tokens(spark, path).collect()) == want


def test_ids_are_those_of_the_library():
    r = random.Random(13)
    parts = ["a", "Ab", " ", "  ", "\n", "\t", "é", "ß", "'s", "'", "12", ".", "!?", "<|endoftext|>", "<|", "\u3000", "日本", "😀", "\r\n", "_", "(", "\x1c", "\u0531", "ª", "²", "٣"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    ids, sizes = Encoder(vocabulary_path(None)).encode(pa.array(texts), 2)
    ends, want = np.cumsum(sizes), library(2)
    assert all(ids[e - n : e].tobytes() == want(t) for t, e, n in zip(texts, ends, sizes, strict=True))


def test_null_and_repeated_ids_in_token_files(spark):
    rows = [(None, "b"), (3, "a"), (None, "a c"), (3, "b b"), (-1, "x")]
    path = new_path(spark, "tokens")
    write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), path)
    got = read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [-1, 3, 3, None, None]
    want = library(2)
    assert sorted((r["doc_id"] or 99, bytes(r["ids"])) for r in got) == sorted((i or 99, want(t)) for i, t in rows)


def test_file_round_trip():
    r = np.random.default_rng(11)
    by_rank = r.permutation(70_000).astype(np.uint32)
    for n in (0, 1, 3, 4, 5, 999):
        ranks = r.integers(0, 70_000, n).astype(np.uint32)
        sizes = np.array([n - n // 2, n // 2])
        docs, lengths, ids, _ = decode_file(encode_file(np.array([5, 6]), sizes, ranks), by_rank)
        assert docs.tolist() == [5, 6] and lengths.tolist() == sizes.tolist() and np.array_equal(ids, by_rank[ranks])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert substring_dedup(empty).count() == line_dedup(empty).count() == minhash_dedup(empty).count() == 0
    assert leaks(empty, items).count() == compare_with_next(empty).count() == token_counts.count_tokens(empty).count() == 0
    assert license_scan(empty).count() == pack(empty).count() == 0
    assert fit(empty)[0] == []
    path = new_path(spark, "tokens")
    write_tokens(empty, path)
    assert read_tokens(spark, path).count() == 0


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d e f g\nx\ny\nz", 1, 2, 3), (1, "a b c d e f g\nx\ny\nz", 4, 5, 6), (1, None, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, batch int, star int, rep int")
    assert substring_dedup(docs).count() == minhash_dedup(docs).count() == compare_with_next(docs).count() == 3
    assert line_dedup(docs).count() == 3 and line_dedup(docs).columns[:5] == docs.columns
    assert license_scan(docs).count() == 3 and pack(docs).count() == 3


def test_chunks_of_the_older_generation_are_taken_over_at_once(monkeypatch):
    encoder = Encoder(vocabulary_path(None))
    texts = pa.array(["one two drei, fünf", "two drei, one\nsix"])
    due = encoder.encode(texts, 2)
    encoder.old, encoder.young = encoder.young, {}
    monkeypatch.setattr(encoder, "_head", encoder._whole)
    monkeypatch.setattr(encoder, "_known", lambda chunk: pytest.fail("looked up one by one"))
    got = encoder.encode(texts, 2)
    assert got[0].tolist() == due[0].tolist() and got[1].tolist() == due[1].tolist() and encoder.young


def test_a_known_word_with_marks_behind_is_not_merged_again(monkeypatch):
    encoder = Encoder(vocabulary_path(None))
    due = Encoder(vocabulary_path(None)).encode(pa.array(["a reeror.\nOnention, w\u0142asna! 2024?"]), 2)[0].tolist()
    encoder.encode(pa.array(["a reeror w\u0142asna 2024 x\nOnention"]), 2)
    encoder.encode(pa.array(["x ! . , ?"]), 2)
    monkeypatch.setattr(encoder, "pieces", lambda word: pytest.fail(f"{word} was merged again"))
    assert encoder.encode(pa.array(["a reeror.\nOnention, w\u0142asna! 2024?"]), 2)[0].tolist() == due


def test_a_tokenizer_that_is_not_taken_directly_remembers_nothing_of_its_probe(monkeypatch):
    monkeypatch.setattr(Encoder, "_word", lambda self, lead, word: b"" if word == "Neu" else None)
    encoder = Encoder(vocabulary_path(None))
    assert not encoder.direct and not encoder.young
    text = "Ende$$\nNeu Ende$$ Ma\u00dfe"
    assert encoder.encode(pa.array(["x " + text]), 2)[0].tolist() == [*encoder.tokenizer.encode("x " + text, add_special_tokens=False).ids, 2]


def test_an_idle_worker_keeps_few_chunks(monkeypatch):
    from spanloom.llm import tokens

    path = tokens.vocabulary_path(None)
    monkeypatch.setattr(tokens, "KEPT", 20)
    texts = [" ".join(f"common w{k}" for k in range(a, a + 200)) for a in (0, 200)]
    batches = [pa.RecordBatch.from_pydict({"text": [x, None]}) for x in texts]
    for _ in range(2):  # the second task meets what the first left
        got = [ids.tolist() for _, _, _, ids, _ in tokens.encoded(iter(batches), path, 2)]
        assert got == [[*tokens.encoder(path).tokenizer.encode(x, add_special_tokens=False).ids, 2, 2] for x in texts]
        assert len(tokens.encoder(path).young) == 20 and not tokens.encoder(path).old and "w0" in tokens.encoder(path).young
