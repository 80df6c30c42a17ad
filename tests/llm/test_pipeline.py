"""The pipeline: every stage on its own input, and all of them."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    quality, toxicity, lines, near, packing = (f for _, f in corpus_pipeline.STAGES)

    good = quality(spark, docs, SF)
    kept = {r[0] for r in good.select("doc_id").collect()}
    assert good.schema == docs.schema
    clean = [i for i, r in labels.items() if r["quality"] == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean) and sum(i in kept for i, r in labels.items() if r["quality"] == 0) <= 0.1 * (len(labels) - len(clean))

    mild = toxicity(spark, good, SF)
    left = {r[0] for r in mild.select("doc_id").collect()}
    assert mild.schema == docs.schema and left < kept

    short = lines(spark, mild, SF)
    assert short.columns == docs.columns and short.count() == mild.count()
    assert short.selectExpr("sum(length(text)) AS n").first()["n"] < mild.selectExpr("sum(length(text)) AS n").first()["n"]

    single = near(spark, docs, SF)
    rows = single.select("doc_id", "text").collect()
    assert single.columns == docs.columns and len({r["text"] for r in rows}) == len(rows)
    assert packing(spark, docs.limit(50), SF).count() >= 50


def test_stages_take_odd_rows(spark):
    """Nulls, empty and very long texts, repeated ids and rows, an empty table, and columns named as those inside."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    texts = [(1, None), (2, ""), (None, " \n"), (3, long), (3, "another text under that id, short enough."), (4, "The same row twice."), (4, "The same row twice."), (None, "A text without id."), (None, None)]
    rows = [(i, t, "en", "s", len(t or ""), k, 1.0, "x", k) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row long, quality double, toxicity string, c1 int")
    given = sorted(map(tuple, docs.collect()), key=str)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        got = sorted(map(tuple, out.collect()), key=str)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        if name == "line dedup":
            assert [(r[0], *r[2:4], *r[5:]) for r in sorted(got, key=lambda r: r[5])] == [(r[0], *r[2:4], *r[5:]) for r in sorted(given, key=lambda r: r[5])]
        else:
            assert set(got) <= set(given)
        if name == "simhash near-dedup":
            assert {(r[0], r[1]) for r in got if (r[1] or "").strip()} == {(i, t) for i, t in texts if (t or "").strip()} and len(got) == 5
        assert stage(spark, docs.limit(0), SF).count() == 0
    packed = corpus_pipeline.pack(spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {1, 2, 3, 4, None} and corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0


def test_near_stage_keeps_one_of_repeated_rows(spark):
    rows = [(1, "same words in a row here"), (1, "same words in a row here"), (2, "same words in a row here"), (3, "something else entirely, with other words"), (None, "a text without id is its own"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.one_of_each(spark, docs, SF).collect()
    assert sorted((r["doc_id"] for r in out), key=str) == [1, 3, 4, None]


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def _shingles(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_stage_finds_near_copies(spark):
    """One text of each component at a five-word similarity of 0.8, as brute force has it."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(150)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 6, 9):
            copy = list(base)
            for at in rng.sample(range(150), changes):
                copy[at] = word()
            texts.append(" ".join(copy))
    sets = [_shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared / (len(sets[i]) + len(sets[j]) - shared) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert len(set(label)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()) == sorted(set(label))


def test_near_stage_keeps_different_texts_of_one_id(spark):
    """Null ids and repeated ids are deduplicated within a component only."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4)), (8, text(4)), (None, text(4)), (9, text(5)), (None, text(5))]
    out = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(None, text(0)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (9, text(5))], key=str)
