"""Readers, writers and streaming forms."""

from __future__ import annotations

import bz2

import pytest
from pyspark.sql import functions as F

from wordloom.operators import corpus, topic_models, topics
from wordloom.operators.matches import elo
from wordloom.sources import readers, writers
from wordloom.streaming.incremental import running_cells, running_elo


def put(path, text):
    path.write_bytes(bz2.compress(text.encode()) if path.suffix == ".bz2" else text.encode())
    return str(path)


def test_spaces(spark, tmp_path):
    a, b = put(tmp_path / "a.tsv", "cat/NN\tfur\t2\n\ncat/NN\tpaw\t0\n"), put(tmp_path / "b.tsv.bz2", 'dog/NN\tsays "woof"\t1.5\n')
    space = readers.read_space(spark, a, b)
    assert sorted(map(tuple, space.collect())) == [("cat/NN", "fur", 2.0), ("dog/NN", 'says "woof"', 1.5)]
    writers.write_space(space, str(tmp_path / "out"), digits=3)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["cat/NN\tfur\t2.000", 'dog/NN\tsays "woof"\t1.500']
    dense = readers.read_dense(spark, put(tmp_path / "d.txt", "cat\t1 2.5\n"))
    writers.write_dense(dense, str(tmp_path / "dense"), "bzip2")
    assert [tuple(r) for r in readers.read_dense(spark, str(tmp_path / "dense")).collect()] == [("cat", [1.0, 2.5])]


def test_tables(spark, tmp_path):
    assert [r[0] for r in readers.read_words(spark, put(tmp_path / "w", " a b\n\nc\n")).collect()] == ["a", "b", "c"]
    assert [tuple(r) for r in readers.read_labels(spark, put(tmp_path / "l", "1\tcat/NN\nbroken\n")).collect()] == [(1, "cat/NN")]
    assert [tuple(r) for r in readers.read_associations(spark, put(tmp_path / "as", "cat\tdog\t3\n")).collect()] == [("cat", "dog", 3)]
    assert [tuple(r) for r in readers.read_pairs(spark, put(tmp_path / "p", "cat\tdog\n")).collect()] == [("cat", "dog")]
    ratings = readers.read_ratings(spark, put(tmp_path / "r.csv", "compound,const,s1,s2\nk,h,1,\nk,m,,7\n"), put(tmp_path / "r2.csv", "compound,const,s3\nk,h,2\n"))
    assert sorted(map(tuple, ratings.collect())) == [("k", "h", "s1", 1.0), ("k", "h", "s3", 2.0), ("k", "m", "s2", 7.0)]
    gold = readers.read_gold_pairs(spark, put(tmp_path / "g", "x_ADJ_NN\tgr&uuml;n Stra%szlig;e\t0.5\n")).first()
    assert (gold["left"], gold["right"], gold["left_pos"], gold["right_pos"]) == ("grün", "Straße", "ADJ", "NN")
    vocabulary = spark.createDataFrame([("grün/ADJD",), ("grün/ADJA",), ("Straße/NN",)], "label string")
    assert topics.resolve_tags(spark.createDataFrame([("grün", "ADJ"), ("blau", "ADJ")], "word string, pos string"), vocabulary).first()["label"] == "grün/ADJA"
    boxes = readers.read_boxes(spark, put(tmp_path / "b.xml", "<annotation><object><name>cat</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>"))
    assert tuple(boxes.first())[1:] == ("cat", 1.0, 2.0, 3.0, 4.0)


def test_corpus_lines_are_numbered_in_order(spark, tmp_path):
    lines = readers.read_corpus_lines(spark, put(tmp_path / "c", "12:1 45,123:6\n67:2\n1,2,3:4\n"))
    assert sorted(map(tuple, corpus.parse(lines).collect())) == [(0, 12, 0, 0, 1), (0, 45, 123, 0, 6), (1, 67, 0, 0, 2), (2, 1, 2, 3, 4)]


def test_models(spark, tmp_path):
    for k in (1, 2):
        writers.save_model({"word": spark.createDataFrame([(0, 1, 0.5 * k)], "topic int, item int, p double")}, str(tmp_path), k)
    assert writers.load_model(spark, str(tmp_path), ["word"])["word"].first()["p"] == 1.0
    assert writers.load_model(spark, str(tmp_path), ["word"], 1)["word"].first()["p"] == 0.5
    with pytest.raises(ValueError):
        writers.save_model({"word": spark.createDataFrame([(float("nan"),)], "p double")}, str(tmp_path), 3)


def test_streams(spark, tmp_path):
    cells = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("b", "y", 1.0)], "target string, context string, value double")
    cells.write.parquet(str(tmp_path / "cells"))
    stream = spark.readStream.schema(cells.schema).parquet(str(tmp_path / "cells"))
    q = running_cells(stream).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["target"], r["value"]) for r in spark.table("cells").collect()} == {("a", 3.0), ("b", 1.0)}

    matches = spark.createDataFrame([("g", k, k % 3, (k + 1) % 3, (k % 2) / 1.0) for k in range(30)], "run string, trial long, a long, b long, score double")
    matches.coalesce(1).write.parquet(str(tmp_path / "matches"))
    stream = spark.readStream.schema(matches.schema).parquet(str(tmp_path / "matches"))
    q = running_elo(stream, "run").writeStream.outputMode("update").format("memory").queryName("ratings").start()
    q.processAllAvailable()
    q.stop()
    batch = {r["item"]: r["rating"] for r in elo(matches).collect()}
    assert {r["item"]: r["rating"] for r in spark.table("ratings").collect()} == pytest.approx(batch)


def test_topic_models_find_two_blocks(spark):
    rows = [(d, w, 0, 0, 5) for d in range(40) for w in ((1, 2, 3) if d % 2 else (4, 5, 6))]
    docs = spark.createDataFrame(rows, "doc long, word int, feat int, feat2 int, count int")
    model = topic_models.OnlineTopics(topic_models.Settings(topics=2, sizes=(7,), batch=40, alpha=0.1, eta=0.1, tau=1.0, kappa=0.5)).fit(docs, 8)
    best = topics.top_items(model.tables(spark)["word"], 3).groupBy("topic").agg(F.sort_array(F.collect_list("item")).alias("items"))
    assert sorted(r["items"] for r in best.collect()) == [[1, 2, 3], [4, 5, 6]]
    assert model.trace[-1][1] >= model.trace[0][1]


def test_evaluation_tables_by_name(spark, tmp_path):
    for name, words in (("train", "grün Haus"), ("valid", "blau Haus"), ("test", "rot Haus")):
        put(tmp_path / f"disco.{name}.tsv", f"x_ADJ_NN\t{words}\t{len(words)}.5\n")
    head, mod = "Haustür\tTür\t6\n", "Haustür\tHaus\t5\n"
    for name, text in (("comp", mod + head + "Haustür\tHaustür\t7\n"), ("comp.head", head), ("comp.mod", mod)):
        put(tmp_path / f"{name}.tsv", "compound\tconst\tmean\n" + text)
    put(tmp_path / "schm280.tsv", "Translation Word 1\tTranslation Word 2\tHuman (mean)\ngrün\tHaus\t3\ngrün\tMaus\t3\n")
    vocabulary = spark.createDataFrame([(w,) for w in ("grün/ADJD", "blau/ADJA", "rot/ADJA", "Haus/NN", "Tür/NN", "Haustür/NN")], "label string")
    rows = lambda method: sorted((r["left"], r["right"]) for r in readers.read_eval_table(spark, str(tmp_path), vocabulary, method).collect())
    assert rows("discotrain") == [("grün/ADJD", "Haus/NN")] and rows("discovalid") == [("blau/ADJA", "Haus/NN")]
    assert rows("discotrainvalid") == [("blau/ADJA", "Haus/NN"), ("grün/ADJD", "Haus/NN")]
    assert len(rows("disco")) == 3
    assert rows("comp") == [("Haus/NN", "Haustür/NN"), ("Tür/NN", "Haustür/NN")]
    assert rows("comphead") == [("Tür/NN", "Haustür/NN")] and rows("compmod") == [("Haus/NN", "Haustür/NN")]
    assert rows("schm280") == [("grün/ADJD", "Haus/NN")]
    with pytest.raises(ValueError, match="not supported"):
        rows("wordsim")


def test_vocabulary_lines_and_downloads(spark, tmp_path):
    skipped = readers.read_space(spark, put(tmp_path / "s.tsv", "word\tdim\tweight\ncat/NN\tfur\t2\n"), skip_first=True)
    assert [tuple(r) for r in skipped.collect()] == [("cat/NN", "fur", 2.0)]
    names = readers.read_vocabulary(spark, put(tmp_path / "v", "12 Haus/NN\n3 gehen/VVINF\n1 Haus/NE\n"))
    assert sorted(r["word"] for r in names.collect()) == ["Haus", "gehen"]
    rows = readers.read_downloads(spark, put(tmp_path / "d", "cat\thttp://x.org/a/b.jpg?s=1\ncat\thttp://x.org/c.png\n"))
    assert {r["name"].split("-", 1)[1] for r in rows.collect()} == {"b.jpg", "c.png"}
    done = rows.filter("url LIKE '%c.png'").select("name")
    assert [r["url"] for r in readers.read_downloads(spark, str(tmp_path / "d"), done).collect()] == ["http://x.org/a/b.jpg?s=1"]


def test_images_in_archives(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, data in (("x/1.jpg", b"one"), ("2.jpg", b"two")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    put(tmp_path / "broken.tar", "no archive at all")
    found = readers.read_image_members(spark, str(tmp_path / "*.tar")).collect()
    assert {(r["member"], bytes(r["content"])) for r in found} == {("x/1.jpg", b"one"), ("2.jpg", b"two")}
