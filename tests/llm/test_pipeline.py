"""The corpus pipeline: each stage against brute force, on nulls, repeats and an empty table."""

import random
import re

import pytest

pytest.importorskip("spanloom.llm.queries")

import corpus_pipeline as pipeline  # noqa: E402
from spanloom.llm.decontaminate import align  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], SCHEMA)


def texts_of(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in df.collect())


@pytest.fixture(scope="module")
def benchmark_dir(spark, tmp_path_factory):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(4)]
    folder = tmp_path_factory.mktemp("bench")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def test_language_stage_without_labels(spark):
    rows = [(i, "some text", None, "s") for i in range(3)]
    assert pipeline.language_stage(spark, frame(spark, rows), "").count() == 3


def test_language_stage(spark):
    r = random.Random(32)
    sounds = {"en": "the and thing with of er", "de": "der und schon fur ich ein"}
    text = lambda k: " ".join(r.choice(sounds[k].split()) for _ in range(20))
    rows = [(i, text(k), k, "s") for i, k in enumerate(list(sounds) * 20)]
    odd = [(3, "12 34", "en", "s"), (None, "!!", "en", "s"), (None, text("de"), None, "s"), (50, None, "en", "s"), (51, "", None, None)]
    got = pipeline.language_stage(spark, frame(spark, rows + odd), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # rows without letters go, and only they: another row of doc_id 3 and one without doc_id stay
    assert texts_of(got) == sorted([(i, t) for i, t, *_ in rows] + [(-1, odd[2][1])])


def test_line_stage(spark):
    rows = [(1, "a\nb\nc\nd", "en", "s"), (2, "a\nb\nc", "en", "s"), (3, "x\na\nb\nc", "en", "s"), (3, "y", "en", "s"), (4, None, "en", "s"), (5, "", "en", "s")]
    got = pipeline.line_stage(spark, frame(spark, rows), "")
    assert texts_of(got) == [(1, "a\nb\nc\nd"), (3, "x"), (3, "y"), (4, ""), (5, "")]
    assert {r["n_chars"] for r in got.collect() if r["text"] == "x"} == {1}


def test_near_stage(spark):
    x, y, z = (" ".join(f"{k}{i}" for i in range(40)) for k in "xyz")
    near = x.replace(" x39", " other")
    unique = [(1, x, "en", "s"), (4, near, "en", "s"), (2, y, "en", "s"), (3, z, "en", "s"), (9, z, "en", "s"), (10, "", "en", "s"), (11, None, "en", "s")]
    assert texts_of(pipeline.near_stage(spark, frame(spark, unique), "")) == [(1, x), (2, y), (3, z), (10, ""), (11, "")]
    # repeated and missing ids: no text is lost, one row of each group stays
    rows = [(1, x, "en", "s"), (5, x, "en", "s"), (5, y, "en", "s"), (7, y, "en", "s"), (None, z, "en", "s"), (None, z, "en", "s"), (None, None, "en", "s"), (7, y, "en", "s")]
    assert sorted(t for _, t in texts_of(pipeline.near_stage(spark, frame(spark, rows), ""))) == ["", x, y, z]


def test_benchmark_stage(spark, benchmark_dir):
    folder, items = benchmark_dir
    r = random.Random(33)
    noise = lambda: " ".join("".join(r.choice("klmnop") for _ in range(4)) for _ in range(30))
    rows = [(i, f"{noise()} {items[i % 4][1] if i % 3 == 0 else ''} {noise()}", "en", "s") for i in range(12)]
    rows += [(None, noise(), "en", "s"), (None, items[0][1], "en", "s"), (1, items[1][1], "en", "s"), (20, None, "en", "s")]
    want = []
    for i, t, *_ in rows:
        if not any(align(WORD.findall(x), WORD.findall(t or " "))[0] >= 0.5 for _, x in items):
            want.append((i if i is not None else -1, t or ""))
    assert texts_of(pipeline.benchmark_stage(spark, frame(spark, rows), folder)) == sorted(want)


def test_run(spark, benchmark_dir):
    folder, items = benchmark_dir
    r = random.Random(34)
    text = lambda: " ".join(r.choice("the and thing with of er other words here".split()) + str(r.randint(0, 9)) for _ in range(60))
    clean = [text() for _ in range(10)]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean)] + [(20, clean[3], "en", "s"), (21, "12 34 56", "en", "s"), (22, clean[1][:40] + " " + items[2][1], "en", "s"), (None, None, None, None)]
    frame(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = pipeline.run(spark, folder).collect()
    assert {x["doc_id"] for x in got} == set(range(10))
    assert all(x["length"] <= 2048 for x in got)


def test_run_on_an_empty_table(spark, benchmark_dir, tmp_path):
    folder, _ = benchmark_dir
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
