"""Feature suggestions: few pairs are met, the best ones are those of all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators import norms


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def expected(features, most=5):
    out = set()
    for a, _ in features:
        best = sorted((-math.log(n) / distance(a, b), b) for b, n in features if b != a)[:most]
        out |= {(a, b, k) for k, (_, b) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize(("n", "totals"), [(1, [3.0]), (4, [1.0, 5.0]), (150, [1.0]), (150, [1.0, 2.0, 900.0]), (200, None)])
def test_best_as_of_all_pairs(spark, n, totals):
    rng = random.Random(n)
    names = sorted({"".join(rng.choices("abcde", k=rng.randrange(1, 14))) for _ in range(n)})
    features = [(w, rng.choice(totals) if totals else float(int(1000 / (k + 1)) + 1)) for k, w in enumerate(rng.sample(names, len(names)))]
    df = spark.createDataFrame(features, "feature string, total double")
    found = {(r["feature"], r["other"], r["rank"]) for r in norms.suggestions(df).collect()}
    assert found == expected(features)


def test_few_pairs_are_met(spark):
    """2,000 names whose totals fall as in a text: below a tenth of all pairs."""
    df = spark.range(1, 2001).select(F.substring(F.md5(F.col("id").cast("string")), 1, (4 + F.col("id") % 9).cast("int")).alias("feature"), F.ceil(5_000 / F.col("id")).cast("double").alias("total")).dropDuplicates(["feature"])
    n = df.count()
    assert norms.suggestion_pairs(df).count() < n * n / 10


def test_empty_table(spark):
    assert norms.suggestions(spark.createDataFrame([], "feature string, total double")).collect() == []


def test_association_pipeline_by_hand(spark):
    """Sparse percentiles against cosines of all words in numpy, zeros and negative ones among them."""
    import numpy as np

    rng = np.random.default_rng(5)
    words = ["a/NN", "b/NN", "b/VV", "c/NN", "d/NN", "e/NN"]
    x = rng.standard_normal((6, 5)) * (rng.random((6, 5)) < 0.5)
    x[:, 0] += np.array([1, 0, 1, 0, 0, 1])
    x[4] = [0, 0, 0, 0, 2.0]
    cells = [(w, f"x{j}", float(x[i, j])) for i, w in enumerate(words) for j in range(5) if x[i, j]]
    space = spark.createDataFrame(cells, "target string, context string, value double")
    n = spark.createDataFrame([("a", "b", 3), ("a", "a", 9), ("a", "d", 1), ("a", "zzz", 4), ("zzz", "a", 1), ("c", "e", 2)], "cue string, response string, count long")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    cos = np.round(unit @ unit.T, 12)
    pct = lambda i: np.array([np.ceil((cos[i] < v).sum() + ((cos[i] == v).sum() + 1) / 2) for v in cos[i]]) / 6
    hits = [max(pct(0)[1:3])] * 3 + [pct(0)[4]] + [pct(3)[5]] * 2
    r = norms.association_pipeline(space, n).first()
    assert (r["n"], r["own"], r["unknown"], r["higher"]) == (6, 1, 2, 1)
    assert r["mean"] == pytest.approx(np.mean(hits)) and r["std"] == pytest.approx(np.std(hits)) and r["p50"] == pytest.approx(np.percentile(hits, 50))
    assert r["low"] < r["low50"] < r["mean"] < r["high50"] < r["high"]
    ranks = {(k["cue"], k["word"]): k["pct"] for k in norms.sparse_percentiles(space, spark.createDataFrame([("a",)], "word string")).collect()}
    assert all(ranks[k] == pytest.approx(pct(0)[words.index(k[1])]) for k in ranks if k[1])


def test_association_pipeline_makes_its_tables_once(spark):
    made = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    space = spark.createDataFrame([("a/NN", "x", 1.0), ("b/NN", "x", 2.0), ("b/NN", "y", 1.0), ("c/V", "y", 3.0)], "target string, context string, value double")
    links = spark.createDataFrame([("a", "b", 3), ("b", "c", 2), ("a", "a", 1)], "cue string, response string, count long")
    row = norms.association_pipeline(space.mapInArrow(noted, space.schema), links.mapInArrow(noted, links.schema)).first()
    assert row["n"] == 5 and made.value == 4 + 3
