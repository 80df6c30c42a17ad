"""Distributed ranks, percentiles and pair counts against plain Python."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import ranks, stats


def rows(seed: int, n: int, spread: int = 9):
    rng = random.Random(seed)
    return [(rng.choice("ab"), i, float(rng.randrange(spread)), rng.choice([None, *map(float, range(spread))])) for i in range(n)]


def frame(spark, n=400, **how):
    return spark.createDataFrame(rows(1, n, **how), "g string, key long, gold double, value double").repartition(7)


def test_running_sums(spark):
    df = frame(spark, spread=1000).select("key", (F.col("key") % 5).alias("n"))
    found = {r["key"]: r["before"] for r in ranks.running(df, ["key"], "n").collect()}
    assert found == {k: sum(j % 5 for j in range(k)) for k in range(400)}
    assert sorted(r["before"] for r in ranks.running(df, ["key"]).collect()) == list(range(400))
    assert ranks.running(df.limit(0), ["key"]).collect() == []


@pytest.mark.parametrize("group", [(), ("g",)])
def test_midranks_and_correlations_as_by_windows(spark, group):
    df = frame(spark)
    held = df.filter("value IS NOT NULL")
    windows = held.select("key", stats.midrank("value", *group).alias("r")).collect()
    assert sorted(windows) == sorted(ranks.midranks(df, "value", *group, name="r").select("key", "r").collect())
    a = sorted(map(tuple, ranks.rank_correlation(df, "gold", "value", *group).collect()))
    wide = held.select(*group, stats.midrank("gold", *group).alias("x"), stats.midrank("value", *group).alias("y"))
    b = sorted(map(tuple, wide.groupBy(*group).agg(stats.moments_rho("x", "y"), F.count("*")).collect()))
    assert [x[:-2] for x in a] == [x[:-2] for x in b] and np.allclose([x[-2:] for x in a], [x[-2:] for x in b])


def test_correlation_of_a_constant_or_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert ranks.rank_correlation(df, "x", "y").collect() == [(-1.0, 2)]
    assert ranks.rank_correlation(df, "x", "y", undefined=None).first()["rho"] is None
    assert ranks.rank_correlation(df.limit(0), "x", "y").collect() == [(-1.0, 0)]


@pytest.mark.parametrize("group", [(), ("g",)])
def test_percentiles_as_by_sparks_own(spark, group):
    df = frame(spark).withColumn("n", F.col("key") % 4)
    shares = (0.0, 0.05, 0.25, 0.5, 0.9, 1.0)
    a = ranks.percentiles(df, "value", "n", *group, shares=shares).collect()
    b = df.filter("n > 0").groupBy(*group).agg(F.percentile("value", F.array(*map(F.lit, shares)), F.col("n")).alias("p")).collect()
    assert np.allclose(sorted([*r][len(group) :] for r in a), sorted(r["p"] for r in b))


def test_below():
    rng = np.random.default_rng(0)
    values, first, bound = rng.integers(0, 50, 200), rng.integers(0, 201, 300), rng.integers(0, 60, 300)
    assert ranks.below(values, first, bound).tolist() == [int((values[:a] < b).sum()) for a, b in zip(first, bound, strict=True)]
    assert ranks.below(np.zeros(0, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64)).tolist() == [0]


@pytest.mark.parametrize("size", [None, 7, 64])
def test_dominated(spark, size):
    rng = np.random.default_rng(1)
    py = rng.permutation(150)
    points = spark.createDataFrame([(i, int(p)) for i, p in enumerate(py)], "px long, py long")
    asked = [(int(a), int(b)) for a, b in zip(rng.integers(0, 151, 80), rng.integers(0, 151, 80), strict=True)]
    found = ranks.dominated(points, spark.createDataFrame(asked, "a long, b long"), size).collect()
    assert sorted(map(tuple, found)) == sorted((a, b, int((py[:a] < b).sum())) for a, b in asked)


def brute(data, gap):
    """By group: pairs at least ``gap`` apart in key order, hits, and pairs whose gold rises."""
    out = {}
    for g in "ab":
        own = sorted((k, x, v) for h, k, x, v in data if h == g and v is not None)
        pairs = [(a, b) for a, b in itertools.combinations(own, 2) if round(abs(a[1] - b[1]), 9) >= gap]
        out[g] = (len(pairs), sum((a[1] < b[1]) == (a[2] < b[2]) for a, b in pairs), sum(a[1] < b[1] for a, b in pairs))
    return out


@pytest.mark.parametrize(("gap", "spread", "size"), [(1.0, 9, None), (2.5, 9, 16), (3.0, 1000, 32)])
def test_pairs_ordered_alike(spark, gap, spread, size):
    data = rows(3, 150, spread)
    df = spark.createDataFrame(data, "g string, key long, gold double, value double").repartition(5)
    found = {r["g"]: (r["pairs"], r["hits"], r["first_less"]) for r in ranks.ordered_alike(df, gap, "g", size=size).collect()}
    assert found == brute(data, gap)


def test_no_pairs(spark):
    df = frame(spark, spread=1)
    assert ranks.ordered_alike(df, 1.0, "g").collect() == []
