"""Factors of sparse spaces against numpy's, and blocks of cosines."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions.tiles import every_pair
from wordloom.operators import factor, images, similarity
from wordloom.operators import ratings as R
from wordloom.sources import writers


def space(spark, rows=30, columns=18, seed=0):
    rng = np.random.default_rng(seed)
    matrix = rng.standard_normal((rows, columns)) * (rng.random((rows, columns)) < 0.4) * np.linspace(3, 0.5, columns)
    cells = [(f"t{i:02}", f"c{j:02}", float(matrix[i, j])) for i in range(rows) for j in range(columns) if matrix[i, j]]
    return spark.createDataFrame(cells, "target string, context string, value double").repartition(3), matrix


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[int(r["target"][1:]), int(r["context"][1:])] = r["value"]
    return out


def test_singular_values_and_vectors(spark):
    df, matrix = space(spark)
    left, sigmas, right = factor.space_svd(df, 4, extra=6)
    u, s, v = np.linalg.svd(matrix, full_matrices=False)
    found = [r["sigma"] for r in sigmas.orderBy("k").collect()]
    assert np.abs(np.array(found) - s[:4]).max() < 1e-6
    low = (u[:, :4] * s[:4]) @ v[:4]
    assert np.abs(dense(factor.reduce_space(left, sigmas, right), matrix.shape) - low).max() < 1e-4
    two = (u[:, :2] * s[:2]) @ v[:2]
    assert np.abs(dense(factor.reduce_space(left, sigmas, right, max_dim=2), matrix.shape) - two).max() < 1e-4
    cut = (s[1] + s[2]) / 2
    assert np.abs(dense(factor.reduce_space(left, sigmas, right, min_sigma=float(cut)), matrix.shape) - two).max() < 1e-4
    wanted = df.select("target", "context").limit(5)
    some = {(r["target"], r["context"]): r["value"] for r in factor.reduce_space(left, sigmas, right, wanted=wanted).collect()}
    assert len(some) == 5 and all(abs(x - low[int(t[1:]), int(c[1:])]) < 1e-4 for (t, c), x in some.items())
    lengths = factor.latent(left, sigmas).groupBy("k").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("s")).orderBy("k").collect()
    assert np.allclose([r["s"] for r in lengths], s[:4], atol=1e-6)


def test_few_dimensions_and_least_sigma(spark):
    matrix = np.array([[1.0, 2, 0], [0, 1, 3], [4, 0, 1], [1, 1, 1]])
    df = spark.createDataFrame([(f"t{i}", f"c{j}", float(matrix[i, j])) for i in range(4) for j in range(3)], "target string, context string, value double")
    s = np.linalg.svd(matrix)[1]
    left, sigmas, right = factor.space_svd(df, 10)
    assert np.allclose([r["sigma"] for r in sigmas.orderBy("k").collect()], s) and right.count() == 9
    assert np.abs(dense(factor.reduce_space(left, sigmas, right), matrix.shape) - matrix).max() < 1e-8
    assert factor.space_svd(df, 10, min_sigma=float(s[1] - 1e-6))[1].count() == 2


def test_empty_space_and_files(spark, tmp_path):
    df, _ = space(spark, 4, 3)
    assert [t.count() for t in factor.space_svd(df.limit(0), 2)] == [0, 0, 0]
    one = factor.space_svd(spark.createDataFrame([("a", "x", 3.0), ("b", "x", 4.0), ("b", "y", 0.0)], df.schema), 2)  # of rank 1
    assert [r["sigma"] for r in one[1].collect()] == [pytest.approx(5.0)]
    factors = factor.space_svd(df, 2)
    writers.write_factors(*factors, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f/sigmas")).count() == 2 and spark.read.parquet(str(tmp_path / "f/left")).count() == factors[0].count()


@pytest.mark.parametrize("turned", [False, True])
def test_a_narrow_space_needs_two_passes_and_no_rounds(spark, monkeypatch, turned):
    rng = np.random.default_rng(8)
    matrix = rng.standard_normal((3, 40)) * (rng.random((3, 40)) < 0.7)
    matrix = np.vstack([matrix, matrix[0] + matrix[1]])  # of rank 3
    matrix = matrix.T if turned else matrix
    cells = [(f"t{i}", f"c{j}", float(x)) for (i, j), x in np.ndenumerate(matrix) if x]
    df = spark.createDataFrame(cells + [(t, c, 0.5) for t, c, _ in cells[:9]] + [(t, c, -0.5) for t, c, _ in cells[:9]], "target string, context string, value double")
    s = np.linalg.svd(matrix, compute_uv=False)
    with monkeypatch.context() as m:
        m.setattr(factor, "_product", None)  # a round joins and sums up all cells
        found = factor.space_svd(df, 4)
    monkeypatch.setattr(factor, "NARROW", 0)
    for left, sigmas, right in (found, factor.space_svd(df, 4)):
        assert np.allclose([r["sigma"] for r in sigmas.orderBy("k").collect()], s[:3])
        assert np.abs(dense(factor.reduce_space(left, sigmas, right), matrix.shape) - matrix).max() < 1e-6


@pytest.mark.parametrize("kind", ["long", "double"])
def test_zero_filled_ratings_whatever_the_way(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    rows = [(f"c{i}", None if i == 2 else "h", s, float(rng.integers(1, 8))) for i in range(5) for s in range(7) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "compound string, const string, subject long, rating double").withColumn("subject", F.col("subject").cast(kind))
    both = []
    for narrow in (512, 0):
        monkeypatch.setattr(factor, "NARROW", narrow)
        both.append({(r["compound"], r["const"], r["subject"]): r["rating"] for r in factor.zero_filled_svd(df, 2).collect()})
    assert both[0].keys() == both[1].keys() and len(both[0]) == 35
    assert max(abs(x - both[1][k]) for k, x in both[0].items()) < 1e-6


def test_low_rank_cells_come_from_as_many_tasks_as_tiles(spark):
    left, right = spark.range(3).selectExpr("id AS l"), spark.range(40_000).selectExpr("id AS r", "1.0D AS x")
    found = every_pair(left, right)
    assert found.count() == 120_000 and found.select(F.spark_partition_id()).distinct().count() > 20


def test_zero_filled_ratings(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{i}", "h/x", s, float(rng.integers(1, 8))) for i in range(6) for s in range(5) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "compound string, const string, subject long, rating double")
    matrix = np.zeros((6, 5))
    for c, _, s, x in rows:
        matrix[int(c[1:]), s] = x
    u, s, v = np.linalg.svd(matrix, full_matrices=False)
    low = (u[:, :2] * s[:2]) @ v[:2]
    found = factor.zero_filled_svd(df, 2).collect()
    assert len(found) == 30 and set(found[0].asDict()) == {*R.COLUMNS}
    assert max(abs(r["rating"] - low[int(r["compound"][1:]), int(r["subject"])]) for r in found) < 1e-4


@pytest.mark.parametrize("tiles", [{}, {"query_tile": 3, "word_tile": 4}])
def test_cosines_of_tiles(spark, tiles):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 6))
    df = spark.createDataFrame([(f"w{i}", v.tolist()) for i, v in enumerate(x)], "word string, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = similarity.cosine_block(df.limit(7), df, **tiles).collect()
    assert len({(r["query"], r["word"]) for r in found}) == len(found) == 140
    assert all(abs(r["cosine"] - unit[int(r["query"][1:])] @ unit[int(r["word"][1:])]) < 1e-12 for r in found)
    assert similarity.cosine_block(df.limit(0), df).count() == 0


def test_described_arrays(spark):
    df = spark.createDataFrame([(1, [0.0, 0.5, 0.1, -1.0]), (2, None), (3, []), (4, [2.0, None])], "id int, v array<double>")
    rows = {(r["id"], r["feature"], r["place"]): r["values"] for r in images.described(df, "v", "bands", "peaks", "tally").collect()}
    assert rows[1, "peaks", 1] == [0.5] and rows[1, "bands", 0] == [0.0, 0.0, 0.0] and rows[1, "tally", 0] == [1.0, 0, 0, 0, 2.0, 0, 1.0, 0]
    assert {k[0] for k in rows} == {1, 4} and rows[4, "tally", 0][7] == 1.0
    images.register_describe(spark)
    df.createOrReplaceTempView("arrays")
    assert spark.sql("SELECT id, f.* FROM arrays, LATERAL describe_features(v, 'peaks') f").collect() == [(1, "peaks", 1, [0.5])]
    with pytest.raises(Exception, match="no feature function"):
        images.described(df, "v", "gist").collect()


def test_boxes_are_cropped_about_their_middle(spark):
    box = spark.range(1).select(images.crop(F.lit(10.0), F.lit(20.0), F.lit(8.0), F.lit(4.0), 0.5).alias("b")).first()["b"]
    assert tuple(box) == (12.0, 21.0, 4.0, 2.0)
