"""Hand-computed cases."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions.columns import mass_outside, pos_of, steps, uniform, word_of, wrap
from wordloom.operators import corpus, factor, matches, noise, stats, topic_models, topics
from wordloom.operators import ratings as R
from wordloom.operators import similarity as S
from wordloom.operators import space as P

SPACE = "target string, context string, value double"


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([("a/NN", "x", 2.0), ("a/NN", "y", 2.0), ("b/VV", "x", 4.0)], SPACE)


def cells(df):
    return {(r["target"], r["context"]): r["value"] for r in df.collect()}


def test_weighting(small):
    pmi = cells(P.pmi(small))
    assert pmi[("a/NN", "x")] == pytest.approx(-0.584962500721) and pmi[("a/NN", "y")] == pytest.approx(1.0) and pmi[("b/VV", "x")] == pytest.approx(0.415037499279)
    assert cells(P.lmi(small))[("b/VV", "x")] == pytest.approx(0.207518749639)
    assert cells(P.neglogprob(small))[("a/NN", "x")] == pytest.approx(2)
    assert cells(P.norm1(small))[("a/NN", "x")] == pytest.approx(0.5)
    assert set(cells(P.weight(small, "pmi", "positive"))) == {("a/NN", "y"), ("b/VV", "x")}
    assert [r[0] for r in P.top_contexts(small, 1).collect()] == ["x"] and [r[0] for r in P.top_contexts(small, 1, "name").collect()] == ["y"]
    with pytest.raises(NotImplementedError):
        P.weight(small, "tfidf")
    assert cells(P.weight(small, "pmi", "pmi"))[("a/NN", "x")] is None  # a negative mass has no logarithm


def test_similarities(spark):
    space = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 2.0), ("b", "x", 4.0)], SPACE)
    pairs = spark.createDataFrame([("a", "b"), ("a", "zz")], "left string, right string")
    r = S.distances(space, pairs).collect()
    assert len(r) == 1
    assert r[0]["cosine"] == pytest.approx(0.707106781187) and r[0]["euclid"] == pytest.approx(2.828427124746) and r[0]["normeuclid"] == pytest.approx(0.765366864730)
    assert r[0]["jaccard"] == 0.5 and r[0]["dot"] == 8
    x, y = [3, 0, 0, 1, 0, -2], [0, 0, 2, 5, 0, -1]
    rows = [(w, f"c{k}", float(v)) for w, vs in (("x", x), ("y", y), ("all", [1] * 6)) for k, v in enumerate(vs) if v]
    rho = S.spearman(spark.createDataFrame(rows, SPACE), spark.createDataFrame([("x", "y")], "left string, right string")).first()["spearman"]
    assert rho == pytest.approx(0.548387096774)


def test_divergences(spark):
    t = spark.createDataFrame([("p", 0, 0.5), ("p", 1, 0.5), ("q", 0, 0.25), ("q", 1, 0.25), ("q", 2, 0.5)], "word string, topic int, p double")
    r = S.divergences(t, spark.createDataFrame([("p", "q")], "left string, right string")).first()
    assert r["kl"] == pytest.approx(1) and r["kl_reversed"] == math.inf and r["js"] == pytest.approx(0.311278124459)


@pytest.fixture(scope="module")
def study(spark):
    table = {("k1", "h"): (1, 2, 2, 7), ("k1", "m"): (3, 3, 3, None), ("k2", "h"): (5, 6, 4, 1), ("k2", "m"): (7, 6, None, 2), ("k3", "h"): (None, 4, None, None)}
    rows = [(*item, f"s{k}", float(v)) for item, vs in table.items() for k, v in enumerate(vs, 1) if v is not None]
    return spark.createDataFrame(rows, "compound string, const string, subject string, rating double")


def test_rating_aggregates(study):
    r = {(x["compound"], x["const"]): x for x in R.aggregate(study).collect()}
    assert (r["k1", "h"]["mean"], r["k1", "h"]["median"]) == (3, 2) and r["k1", "h"]["stddev"] == pytest.approx(2.708013, abs=1e-6)
    assert (r["k3", "h"]["n"], r["k3", "h"]["median"], r["k3", "h"]["stddev"]) == (1, 4, 0)
    means = R.aggregate(study).filter("compound = 'k1'")
    assert [R.combine(means, m).first()["mean"] for m in ("sum", "prod", "gmean", "hmean")] == [6, 9, 3, 3]


def test_cleaning(study):
    kept = {(r["compound"], r["const"], r["subject"]) for r in R.drop_deviant_ratings(study, 1.0).collect()}
    assert kept == {("k1", "h", "s1"), ("k1", "h", "s2"), ("k1", "h", "s3"), ("k2", "h", "s1"), ("k2", "h", "s2"), ("k2", "h", "s3"), ("k2", "m", "s1"), ("k2", "m", "s2")}
    rho = {r["subject"]: (r["rho"], r["n"]) for r in R.agreements(study).collect()}
    assert rho["s1"] == (pytest.approx(0.632455532), 4) and rho["s2"] == (pytest.approx(0.5), 4) and rho["s4"] == (pytest.approx(-0.5), 3)
    assert {r[0] for r in R.drop_deviant_subjects(study, 0.5 - 1e-9).select("subject").distinct().collect()} == {"s1", "s2", "s3"}
    assert {r[0] for r in R.drop_worst_subjects(study, 1).select("subject").distinct().collect()} == {"s1", "s2", "s3"}
    assert {r[0] for r in R.drop_worst_subjects(study, share=0.3).select("subject").distinct().collect()} <= {"s1", "s2", "s3"}


def test_ranks_and_weighted_summary(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, 0.4, 0.4, 0.9)], "v double")
    assert sorted(r["pct"] for r in stats.percentile_rank(df, "v").collect()) == [0.25, 0.75, 0.75, 1]
    assert [r["pct"] for r in stats.percentile_rank(df, "v", descending=True).orderBy("v").collect()] == [1, 0.75, 0.75, 0.25]
    r = stats.weighted_summary(spark.createDataFrame([(0.5, 3), (0.9, 1)], "v double, c long"), "v", "c").first()
    assert r["mean"] == pytest.approx(0.6) and r["std"] == pytest.approx(0.173205080757)
    assert [r[f"p{k}"] for k in (5, 10, 25, 50, 75, 90, 95)] == pytest.approx([0.5, 0.5, 0.5, 0.5, 0.6, 0.78, 0.84])


def test_matches(spark):
    df = spark.createDataFrame([(1, 1, 2, 1.0), (2, 1, 2, 0.5), (3, 2, 1, 1.0)], "trial long, a long, b long, score double")
    r = {x["item"]: x["rating"] for x in matches.elo(df.repartition(3)).collect()}
    assert r[1] == pytest.approx(1499.9999974097, abs=1e-9) and r[1] + r[2] == pytest.approx(3000)


def test_functions(spark):
    df = spark.createDataFrame([(k,) for k in range(1, 8)], "x int")
    assert [r[0] for r in df.orderBy("x").select(wrap(F.col("x") + 3)).collect()] == [4, 5, 6, 7, 1, 2, 3]
    assert [r[0] for r in df.orderBy("x").select(wrap(F.col("x") - 3)).collect()] == [5, 6, 7, 1, 2, 3, 4]
    words = spark.createDataFrame([("a/b/NN",), ("word",)], "w string").select(word_of(F.col("w")), pos_of(F.col("w"))).collect()
    assert [tuple(w) for w in words] == [("a/b", "NN"), ("word", "")]
    assert df.limit(1).select(uniform(42, F.lit("a"), F.lit(1))).first()[0] == pytest.approx(0.852912427159)
    assert mass_outside(1.959964) == pytest.approx(0.05, abs=1e-6) and len(steps(1, 4, 0.25)) == 13


def test_corpus(spark):
    lines = spark.createDataFrame([(0, "12:1 45,123:6"), (1, "67:2")], "doc long, value string")
    rows = corpus.parse(lines)
    assert sorted(map(tuple, rows.collect())) == [(0, 12, 0, 0, 1), (0, 45, 123, 0, 6), (1, 67, 0, 0, 2)]
    assert sorted(map(tuple, corpus.features_only(rows).collect())) == [(0, "123:6"), (1, "")]
    assert [tuple(r) for r in corpus.multimodal_only(rows)[0].collect()] == [(0, 1, 123, 0, 6)]
    assert sorted(map(tuple, corpus.formatted(rows).collect())) == [(0, "12:1 45,123:6"), (1, "67:2")]
    with pytest.raises(Exception, match="not a corpus item"):
        corpus.parse(spark.createDataFrame([(0, "1,2,3,4:1")], "doc long, value string")).collect()


def test_significance(spark):
    near = spark.createDataFrame([(i, float(i % 10 < 9), float(i % 10 > 0)) for i in range(20)], "id long, out1 double, out2 double")
    far = spark.createDataFrame([(i, float(i % 20 < 19), float(i % 20 < 2)) for i in range(40)], "id long, out1 double, out2 double")
    assert stats.randomization_test(near, 200).first()["p"] > 0.5 and stats.randomization_test(far, 200).first()["p"] < 0.01


def test_noise_changes_only_what_it_should(study):
    assert noise.blank(study, 1.0).count() == 0 and noise.blank(study, 0.0).count() == study.count()
    assert noise.add_subjects(study, 2).count() == study.count() + 2 * 5
    a = sorted(map(tuple, noise.offset(study.repartition(1), 0.5).collect()))
    assert a == sorted(map(tuple, noise.offset(study.repartition(7), 0.5).collect()))


def test_special_functions():
    assert topic_models.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890], abs=1e-8)
    assert stats.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    low, high = stats.mean_interval(0.0, 1.0, 11)
    assert high == pytest.approx(2.228 / math.sqrt(11), abs=1e-3) and low == -high


def test_completion_recovers_rank_one():
    truth = np.outer([1.0, 2, 3], [1.0, 2, 1.5])
    holes = truth.copy()
    holes[0, 1] = np.nan
    u, v = factor.complete_rank(holes, 1, rate=0.01, tolerance=1e-12)
    assert (u @ v)[0, 1] == pytest.approx(2.0, abs=0.05)


def test_deviant_ratings_at_the_bound(spark):
    draw = np.random.default_rng(3)
    rows = [(f"k{k}", "h", f"s{j}", float(v)) for k in range(200) for j, v in enumerate(draw.integers(1, 8, draw.integers(1, 7)))]
    want = set()
    for k in range(200):
        values = [Fraction(int(r[3])) for r in rows if r[0] == f"k{k}"]
        mean, n = sum(values) / len(values), len(values)
        square = sum((v - mean) ** 2 for v in values) / max(n - 1, 1)
        want |= {(f"k{k}", f"s{j}") for j, v in enumerate(values) if square and (v - mean) ** 2 <= square}
    study = spark.createDataFrame(rows, "compound string, const string, subject string, rating double")
    for parts in (1, 5):
        assert {(r["compound"], r["subject"]) for r in R.drop_deviant_ratings(study.repartition(parts), 1.0).collect()} == want
    assert R.drop_deviant_ratings(study, -1.0).isEmpty() and R.drop_deviant_ratings(study.limit(0), 1.0).isEmpty()
