"""Operator 13: LOBPCG and whitened rows against numpy's eigenvectors."""

from __future__ import annotations

import numpy as np
import pytest

from wordloom.llm import whitening
from wordloom.llm.whitening import lobpcg, whiten


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def expected(vectors: np.ndarray, k: int = 8):
    x = np.floor(1024 * vectors.astype(np.float32).astype(float)).astype(np.int64) + 100_000
    n = len(x)
    y = n * x - x.sum(axis=0)
    values, vecs = np.linalg.eigh((y / n).T @ (y / n) / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    return (y.astype(object) ** 2).sum(axis=1), (y / n) @ vecs[:, :k] / np.sqrt(values[:k]), values / values.sum()


def same(found: list, ids: list, vectors: np.ndarray, k: int = 8) -> None:
    deviation, white, explained = expected(vectors, k)
    got = np.full(white.shape, np.nan)
    place = {v: i for i, v in enumerate(ids)}
    for r in found:
        i, c = place[r["vec_id"]], r["component"] - 1
        got[i, c] = r["whitened"]
        assert r["n"] == len(ids) and r["deviation"] == deviation[i]
        assert abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-9
    sign = np.sign((got * white).sum(axis=0))
    assert len(found) == white.size and np.abs(got * sign - white).max() < 1e-7


@pytest.mark.parametrize(("size", "count"), [(3, 2), (40, 8), (120, 8)])
def test_lobpcg_finds_the_largest(size, count):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((size, size))
    a = a @ a.T
    values, vectors = lobpcg(lambda x: a @ x, size, count)
    true, own = np.linalg.eigh(a)
    assert np.allclose(values, true[::-1][:count], rtol=1e-12)
    assert np.abs(np.abs((vectors * own[:, ::-1][:, :count]).sum(axis=0)) - 1).max() < 1e-10


def test_lobpcg_with_equal_values():
    values, vectors = lobpcg(lambda x: np.diag([5.0] * 4 + [1.0] * 60) @ x, 64, 6)
    assert np.allclose(values, [5, 5, 5, 5, 1, 1]) and np.allclose(vectors.T @ vectors, np.eye(6))


def test_lobpcg_says_when_it_fails():
    with pytest.raises(ArithmeticError):
        lobpcg(lambda x: np.diag(np.linspace(1, 2, 200)) @ x, 200, 3, most_rounds=2)


def test_rows_as_by_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((300, 70)) * np.linspace(1, 3, 70)
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(vectors)]).repartition(5)
    same(whiten(df).collect(), list(range(300)), vectors)


def test_many_tasks_are_added_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((40, 5))
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(vectors)]).repartition(7)
    same(whiten(df, components=3).collect(), list(range(40)), vectors, 3)


def test_odd_rows(spark):
    """Null, empty, other lengths, null and non-finite and huge entries; null and repeated ids; clashing names."""
    rng = np.random.default_rng(3)
    good = rng.standard_normal((30, 4)).astype(np.float32)
    rows = [(i if i % 7 else None, v.tolist()) for i, v in enumerate(good)]
    rows += [(100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 0.0, 0.0]), (104, [1.0, float("nan"), 0.0, 0.0]), (105, [float("inf"), 0.0, 0.0, 0.0]), (106, [3e38, 0.0, 0.0, 0.0])]
    df = table(spark, rows).selectExpr("vec_id", "embedding", "1 AS component", "2 AS n")
    found = whiten(df).collect()
    assert len(found) == 30 * 4 and {r["n"] for r in found} == {30}
    assert sorted((r["vec_id"] for r in found if r["component"] == 1), key=str) == sorted((i for i, _ in rows[:30]), key=str)
    white = np.array(sorted(r["whitened"] for r in found if r["component"] == 1))
    true = expected(good, 4)[1][:, 0]
    assert min(np.abs(white - np.sort(true)).max(), np.abs(white - np.sort(-true)).max()) < 1e-9


def test_deviation_beyond_64_bits_is_null(spark):
    big = 2.0**29
    found = whiten(table(spark, [(i, [big * (i % 3), float(i)]) for i in range(300)]), components=1).collect()
    assert len(found) == 300 and {r["deviation"] for r in found if r["vec_id"] % 3 != 1} == {None}


def test_no_variance_and_empty(spark):
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    found = whiten(table(spark, [(i, [float(i), 5.0, 2.0 * i]) for i in range(9)])).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 9
