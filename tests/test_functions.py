"""Column functions, readers and small operators that no catalogue query holds."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from wordloom.functions import columns
from wordloom.operators import images, noise, ratings, similarity, stats
from wordloom.operators import topics as T
from wordloom.sources import readers, writers


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_gamma_functions(spark):
    for x in (0.01, 0.5, 1.0, 2.5, 30.0, 1e4):
        lg, di, tri = one(spark, columns.lgamma(F.lit(x)), columns.digamma(F.lit(x)), columns.trigamma(F.lit(x)))
        assert lg == pytest.approx(math.lgamma(x), rel=1e-8, abs=1e-8)
        h = 1e-4 * x
        assert di == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-5, abs=1e-5)
        assert tri == pytest.approx((math.lgamma(x + h) - 2 * math.lgamma(x) + math.lgamma(x - h)) / h**2, rel=1e-2, abs=1e-3)


def test_text_functions(spark):
    assert one(spark, columns.url_escape(F.lit("größe & co/ä b")))[0] == "gr%C3%B6%C3%9Fe%20%26%20co%2F%C3%A4%20b"
    found = one(spark, columns.json_strings(F.lit('{"r": {"items": [{"u": "x"}, {"u": "y"}]}}'), "r"), columns.json_strings(F.lit('{"a": "b"}'), "a"), columns.json_strings(F.lit("{}"), "a"))
    assert found[1:] == (["b"], []) and len(found[0]) == 1
    rows = spark.createDataFrame([("b",), (None,), ("z",), ("a",)], "v string")
    assert [r[0] for r in rows.orderBy(columns.in_order(F.col("v"), ["b", "a"])).collect()] == [None, "b", "a", "z"]


def test_corpus_lines_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "c.txt").write_text("".join(f"line {k}\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = readers.read_corpus_lines(spark, str(tmp_path / "c.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, rows)) == [(k, f"line {k}") for k in range(5000)]


def test_gold_tables(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("Translation Word 1\tTranslation Word 2\tHuman (mean)\nHund\tKatze\t7.5\nHund\tlaufen\t2\nHund\tnichts\t1\n")
    vocabulary = spark.createDataFrame([("Hund/NN",), ("Katze/NN",), ("laufen/VVINF",), ("laufen/VVPP",)], "label string")
    found = readers.tagged_pairs(readers.read_human_pairs(spark, str(tmp_path / "h.tsv")), vocabulary).collect()
    assert sorted(map(tuple, found)) == [("Hund/NN", "Katze/NN", 7.5), ("Hund/NN", "laufen/VVINF", 2.0)]
    (tmp_path / "g.tsv").write_text("const\tcompound\tmean\nHaus\tHaustür\t5.5\nTür\tTür\t7\n")
    assert [tuple(r) for r in readers.read_compound_gold(spark, str(tmp_path / "g.tsv")).collect()] == [("Haus/NN", "Haustür/NN", 5.5)]


def test_tables_of_tab_separated_fields(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("a\tx\t2\t9\t3\n")
    (tmp_path / "r.tsv").write_text("a\tx\t0.5\t1\t0.25\n")
    (tmp_path / "s.tsv").write_text("a\t?\tb, c\n")
    (tmp_path / "f.tsv").write_text("a\thas legs\t4\n")
    (tmp_path / "j.csv").write_text("w1,60,95 % (19/20),c,3\n")
    for name, read, wanted in (("w.tsv", readers.read_weighted_space, ("a", "x", 6.0)), ("r.tsv", readers.read_ranked_pairs, ("a", "x", 0.5, 1.0, 0.25)), ("s.tsv", readers.read_raw_associations, ("a", "?", "b, c")), ("f.tsv", readers.read_feature_norms, ("a", "has legs", 4)), ("j.csv", readers.read_judgements, ("w1", "60", "95 % (19/20)", "c", 3))):
        assert [tuple(r) for r in read(spark, str(tmp_path / name)).collect()] == [wanted]
    writers.write_table(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["a", "b"]
    path = str(tmp_path / "cache")
    assert writers.cached_corpus(spark.range(3), path).count() == 3 and writers.cached_corpus(spark.range(9), path).count() == 9
    spark.range(4).write.parquet(str(tmp_path / "source"))
    source = spark.read.parquet(str(tmp_path / "source"))
    written = writers.cached_corpus(source, path)
    assert writers.cached_corpus(source, path).inputFiles() == written.inputFiles() and written.count() == 4


def test_pair_sets_and_measures(spark):
    a = spark.createDataFrame([("a", "b"), ("a", "c")], "left string, right string")
    assert similarity.pair_set(a, a.limit(1)).count() == 2
    with pytest.raises(ValueError):
        similarity.register("cosine")(lambda x, y: F.sum(x))


def test_p_values(spark):
    rows = spark.createDataFrame([(0.5, 20), (1.0, 9), (None, 9), (0.5, 2), (-0.5, 20), (0.0, 5)], "rho double, n long")
    found = [r[0] for r in rows.select(stats.spearman_p("rho", "n")).collect()]
    assert found[0] == pytest.approx(0.024769, abs=1e-5) and found[4] == found[0] and found[1] == 0 and found[2:4] == [None, None] and found[5] == pytest.approx(1)
    low, high = spark.createDataFrame([(1.0, 4.0, 11)], "m double, v double, n int").select(stats.interval_of("m", "v", "n").alias("i")).select("i.*").first()
    assert (low, high) == pytest.approx(stats.mean_interval(1.0, 4.0, 11)) and high - 1 == pytest.approx(2.228 * math.sqrt(4 / 11), abs=1e-3)


def test_trials_are_cleaned_for_themselves(spark):
    rows = [(f"c{k % 5}", "h", f"s{j}", float(1 + (k * j + j * j) % 7)) for k in range(5) for j in range(12)]
    df = spark.createDataFrame(rows, "compound string, const string, subject string, rating double")
    for clean in (lambda r: ratings.drop_deviant_ratings(r, 1.0), lambda r: ratings.drop_worst_subjects(r, 3), lambda r: ratings.drop_worst_subjects(r, share=0.2), lambda r: ratings.drop_deviant_subjects(r, 0.1), ratings.complete):
        single = sorted(map(tuple, clean(df).select(*ratings.COLUMNS).collect()), key=str)
        both = clean(noise.trials(df, 2))
        assert all(sorted(map(tuple, both.filter(f"trial = {t}").select(*ratings.COLUMNS).collect()), key=str) == single for t in (1, 2))
    holes = noise.trials(df.filter("NOT (compound = 'c1' AND subject = 's1')"), 2)
    assert noise.randomize(holes, 1.0).count() == 120


def test_sampled_members(spark):
    members = spark.createDataFrame([(f"k{i % 3}", f"m{i}") for i in range(3000)], "class string, name string")
    some = images.sampled_members(members, spark.createDataFrame([("k1",), ("k2",)], "class string"), 0.25)
    assert 400 < some.count() < 600 and {r[0] for r in some.select("class").distinct().collect()} == {"k1", "k2"}


def test_predicted_associations(spark):
    near = spark.createDataFrame([("a", w, v) for w, v in (("x", 0.1), ("y", 0.5), ("z", 0.9), ("u", 0.95))], "left string, right string, js double")
    norms = spark.createDataFrame([("a", "x", 3), ("a", "z", 1), ("a", "none", 5)], "cue string, response string, count long")
    r = T.predicted_associations(near, norms).first()
    assert r["n"] == 4 and r["mean"] == pytest.approx((3 * 1.0 + 0.5) / 4)


def test_slices_labels_and_lines(spark):
    from wordloom.functions.columns import matching, pasted, relabelled
    from wordloom.operators import similarity, topics

    df = spark.createDataFrame([(1, "a", None), (2, "b", 0.5), (3, None, 0.1)], "k int, s string, x double")
    keys = lambda **c: [r["k"] for r in df.filter(matching(**c)).orderBy("k").collect()]
    assert (keys(x=None), keys(x=...), keys(s=["a", "b"], x=...), keys(s="b"), keys()) == ([1], [2, 3], [2], [2], [1, 2, 3])
    text = df.select(relabelled(F.col("s"), {"a": "alpha"}).alias("l"), relabelled(F.col("k"), {}).alias("k"), pasted("s", "k").alias("p")).collect()
    assert [tuple(r) for r in text] == [("alpha", "1", "a 1"), ("b", "2", "b 2"), (None, "3", "NA 3")]
    assert sorted(r["line"] for r in topics.side_by_side(df.select("s", "k"), "s", "k").collect()) == ["   " + " | " + "3  ", "a   | 1  ", "b   | 2  "]
    a, b = (spark.createDataFrame([("l", "r", v), (n, "r", v)], f"left string, right string, {n} double") for n, v in (("p", 1.0), ("q", 2.0)))
    assert [tuple(r) for r in similarity.joined_measures(a, b).collect()] == [("l", "r", 1.0, 2.0)]


def test_matches_by_item_names(spark):
    from wordloom.operators import matches

    ratings = spark.createDataFrame([(f"c{i}", "h", s, float(i + s)) for i in range(3) for s in range(4)] + [("d", "h", 9, 1.0)], "compound string, const string, subject long, rating double")
    rows = {r["compound"]: r for r in matches.result_table(matches.elo(matches.random_matches(spark, ratings, 300)), ratings).collect()}
    assert set(rows) == {"c0", "c1", "c2", "d"} and rows["c0"]["rating"] < rows["c1"]["rating"] < rows["c2"]["rating"] and rows["d"]["rating"] is None
