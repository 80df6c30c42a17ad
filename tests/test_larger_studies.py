"""Studies with many subjects, vectors and items: results that do not hang on how the work is dealt."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wordloom.functions.columns import cosine, uniform
from wordloom.functions.draws import heads, standard_gammas
from wordloom.operators import ratings as R
from wordloom.operators import corpus, factor, matches, noise, similarity, stats


def study(spark, subjects, items=4):
    rows = [(f"c{i}", "h", s, float(1 + (s * 7 + i * 3) % 5)) for s in range(subjects) for i in range(items) if (s + i) % 3]
    return spark.createDataFrame(rows, "compound string, const string, subject long, rating double")


def test_melting_makes_no_column_a_subject(spark):
    df = study(spark, 300)
    wide = R.wide_cells(df, width=50)
    assert wide.columns == ["compound", "const", "block", "cells"] and wide.select("block").distinct().count() == 6
    assert wide.selectExpr("max(size(cells)) AS n").first()["n"] < 100
    found = {tuple(r) for r in R.long_form(wide).collect()}
    assert found == {(r["compound"], r["const"], str(r["subject"]), r["rating"]) for r in df.collect()}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pairs_of_subjects_by_tiles(spark, kind):
    df = study(spark, 40, items=9).withColumn("subject", F.col("subject").cast(kind))
    a = df.select(*R.ITEM, F.col("subject").alias("left"), F.col("rating").alias("x"))
    both = a.join(df.select(*R.ITEM, F.col("subject").alias("right"), F.col("rating").alias("y")), [*R.ITEM]).filter("left < right")
    plain = stats.spearman(both, "x", "y", "left", "right").join(both.groupBy("left", "right").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("agreement")), ["left", "right"])
    wanted = {(r["left"], r["right"]): (r["n"], r["agreement"], r["rho"]) for r in plain.collect()}
    for tile in (1024, 6):
        found = R.pair_agreement(df, tile=tile).collect()
        assert len(found) == len(wanted) and {(r["left"], r["right"]): (r["n"], pytest.approx(r["agreement"]), pytest.approx(r["rho"])) for r in found} == wanted
    assert R.pair_agreement(df.limit(0)).count() == 0 and R.pair_agreement(df, with_rho=False).columns == ["left", "right", "n", "agreement"]


def test_few_values_are_counted_and_not_listed(spark, monkeypatch):
    rng = np.random.default_rng(9)

    def tile(place, subjects, extra=0):
        """Subjects with one rating of an item, or two of item 0; with ``extra``, a subject with as many values of other items."""
        items = [np.append(np.flatnonzero(rng.random(20) < 0.7), 0) for _ in range(subjects)] + [100 + np.arange(extra)] * (extra > 0)
        ratings = [rng.integers(1, 6, len(x)).astype(float) for x in items[:subjects]] + [100.0 + np.arange(extra)] * (extra > 0)
        names = np.arange(len(items)) + 1000 * place
        return pa.table({"subject": pa.array(names), "items": pa.array(items), "ratings": pa.array(ratings), "a": pa.array([0] * len(items)), "b": pa.array([place] * len(items))})

    def pairs(left, right):
        parts = list(R._agreements_of(left, right))
        assert all(len(t) <= 256 * 1024 for t in parts)
        rows = pa.concat_tables(parts).to_pylist()
        return {(r["one"], r["other"]): (r["n"], r["agreement"], r["rho"]) for r in rows if r["one"] % 1000 < 300 and r["other"] % 1000 < 300}

    for place in (0, 1):
        left, right = tile(place, 300, 500), tile(1, 300) if place else None
        few = left.slice(0, 300)
        listed = pairs(left, left if right is None else right)
        with monkeypatch.context() as m:
            m.setattr(R, "_doubled_midranks", None)
            counted = pairs(few, few if right is None else right)
        assert counted == listed and len(counted) > 40_000

    df = study(spark, 30, items=9)
    plain = {(r["left"], r["right"]): r for r in R.pair_agreement(df).collect()}
    rounded = {(r["left"], r["right"]): r for r in R.pair_agreement(df, digits=2).collect()}
    assert plain.keys() == rounded.keys() and all(abs(r["rho"] - rounded[k]["rho"]) <= 0.005 + 1e-9 and round(rounded[k]["rho"], 2) == rounded[k]["rho"] for k, r in plain.items())


def test_ranks_within_pairs_do_not_need_room_for_all_values():
    rng = np.random.default_rng(4)
    pair, code = rng.integers(0, 3000, 900), rng.integers(0, 4, 900)
    few, many = R._doubled_midranks(pair, code, 3000, 4), R._doubled_midranks(pair, code * 500, 3000, 2000)
    assert (few[0] == many[0]).all() and (few[1] == many[1]).all()
    one = pair == pair[0]
    assert few[0][0] == 2 * (code[one] < code[0]).sum() + (code[one] == code[0]).sum() + 1
    assert few[1][pair[0]] == (few[0][one] ** 2).sum()


@pytest.mark.parametrize("tile", [1024, 5])
def test_cosines_within_groups_by_tiles(spark, tile):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, rng.standard_normal(4).tolist()) for i in range(40)]
    rows += [(7, 1, [1.0, 0.0, 0.0, 2.0]), (50, 0, [0.0] * 4), (51, 0, None), (52, 0, [1.0, 2.0]), (53, 0, [1.0, None, 0.0, 1.0]), (54, None, [1.0] * 4), (None, 1, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    b = df.select("label", F.col("id").alias("b"), F.col("vector").alias("y"))
    plain = df.join(b, "label").filter("id < b").select("id", "b", F.when(F.size("vector") == F.size("y"), cosine(F.col("vector"), F.col("y"))).alias("c")).collect()
    found = similarity.cosine_pairs(df, "id", "label", tile=tile).collect()
    near = lambda rows: sorted((x, y, c is None, round(c or 0.0, 9)) for x, y, c in rows)
    assert near(found) == near(plain)
    assert similarity.cosine_pairs(df.limit(0), "id", "label").count() == 0


def met(monkeypatch):
    """What meets in ``similarity`` from now on: the left side, the right side and the work."""
    seen = []
    monkeypatch.setattr(similarity, "meet", lambda left, right, keys, groups, work, schema: seen.append((left, right, work)))
    return seen


def sides(rows, **columns):
    x = np.random.default_rng(6).standard_normal((2 * rows, 3))
    return [pa.table({**{c: pa.array([kind(i) for i in range(at, at + rows)]) for c, kind in columns.items()}, "vector": pa.array(x[at : at + rows].tolist()), "a": pa.array([0] * rows), "b": pa.array([1] * rows)}) for at in (0, rows)]


def test_cosines_within_groups_shuffle_few_copies_and_go_on_in_parts(spark, monkeypatch):
    seen = met(monkeypatch)
    similarity.cosine_pairs(spark.range(60_000).selectExpr("id", "0 AS label", "array(1.0D, id) AS vector"), "id", "label")
    left, right, work = seen[0]
    assert left.count() + right.count() <= 9 * 60_000
    sizes = [len(t) for t in work(*sides(1500, id=int))]
    assert sum(sizes) == 1500 * 1500 and max(sizes) <= 1 << 19


def test_cosines_of_queries_shuffle_few_copies_and_go_on_in_parts(spark, monkeypatch):
    seen = met(monkeypatch)
    df = spark.range(60_000).selectExpr("concat('w', id) AS word", "array(1.0D, id) AS vector", "id")
    similarity.cosine_block(df.filter("id % 5 = 0"), df)
    left, right, work = seen[0]
    assert left.count() + right.count() <= 2 * 60_000 + 8 * 12_000
    sizes = [len(t) for t in work(*sides(1500, word=str))]
    assert sum(sizes) == 1500 * 1500 and max(sizes) <= 1 << 19


def test_cosines_are_rounded_half_up(spark):
    assert similarity._half_up(np.array([0.25, -0.25, 0.24, -0.01]), 1).tolist() == [0.3, -0.3, 0.2, 0.0]
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 1.0])], "word string, vector array<double>")
    assert {r["cosine"] for r in similarity.cosine_block(df, df, digits=3).collect()} == {1.0, 0.8}


def test_low_rank_cells_are_not_shuffled_by_rank(spark):
    names = [(f"i{i}", f"s{j}") for i in range(5) for j in range(7)]
    rows = [(k, "item", f"i{i}", "h", None, float(i + k)) for k in (1, 2) for i in range(5)] + [(k, "subject", None, None, f"s{j}", float(j - k)) for k in (1, 2) for j in range(7)]
    found = factor.completed(spark.createDataFrame(rows, factor.FACTORS.format(keys="")), 2)
    assert {(r["compound"], r["subject"]): r["rating"] for r in found.collect()} == {(i, s): sum((int(i[1]) + k) * (int(s[1]) - k) for k in (1, 2)) for i, s in names}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan.split("Aggregate")[0]


def test_hidden_cells_are_the_least_of_a_trial_without_a_sort_of_all(spark):
    df = study(spark, 30)
    split = noise.hold_out(df, 5, 3)
    order = W.partitionBy("trial").orderBy(uniform(42, "trial", *R.ITEM, "subject"), *R.ITEM, "subject")
    plain = noise.trials(df, 3).withColumn("held", F.row_number().over(order) <= 5).select(*split.columns)
    assert sorted(split.collect()) == sorted(plain.collect()) and split.filter("held").count() == 15
    assert "WindowGroupLimit" in split._jdf.queryExecution().optimizedPlan().toString()
    assert noise.hold_out(df, 0, 2).filter("held").count() == 0


def test_matches_are_folded_in_batches(spark):
    rows = [(run, t, t % 5, (t * 3 + 1) % 7 + 5, (t % 3) / 2) for run in (1, None) for t in range(60)]
    df = spark.createDataFrame(rows, "run int, trial long, a long, b long, score double").repartition(3)
    state: dict = {}
    for _, _, a, b, s in sorted(rows[:60]):
        matches.play(state, a, b, s)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = matches.elo(df, [("run", "int")])
        assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
        rows = found.collect()
        alone = {r["item"]: r["rating"] for r in matches.elo(df.filter("run = 1")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all({r["item"]: r["rating"] for r in rows if r["run"] == run} == state for run in (1, None)) and alone == state
    assert sum(r["n"] for r in rows) == 240 and matches.elo(df.limit(0)).count() == 0


def test_drawn_numbers_are_those_of_the_column():
    rng = random.Random(2)
    prefixes = [f"42|{rng.randint(0, 10**rng.randint(1, 18))}|{rng.randint(0, 99)}|".encode() for _ in range(50)] + [b"42|", b"7|" + b"x" * 60 + b"|"]
    for some in (prefixes[:-1], prefixes):  # the last one needs a second block
        rows = np.array([rng.randrange(len(some)) for _ in range(400)])
        numbers = np.array([rng.choice((1, 9, 10, 99, 100, 12345)) for _ in rows])
        wanted = [int(hashlib.md5(some[r] + str(n).encode()).hexdigest()[:8], 16) for r, n in zip(rows, numbers, strict=True)]
        assert heads(np.array(some), rows, numbers).tolist() == wanted


def test_injected_features_are_those_of_each_draw_and_counts_below_one_draw_nothing(spark):
    rows = [(d, w, (w or 0) % 2, 0, c) for d in (1, 2, None) for w in (1, 2, 3, None) for c in (5, 30, 0, None)] + [(3, 1, 0, 0, 40_000), (4, 2, 0, 0, -3)]
    corpus_ = spark.createDataFrame(rows, "doc long, word int, feat int, feat2 int, count int")
    p = {1: {4: 5.0, 1: 2.0, 9: 2.0}, 2: {3: 1.0, 7: 1.0}}
    cdf = corpus.descending_cdf(spark.createDataFrame([(w, f, x) for w, fs in p.items() for f, x in fs.items()], "word int, feat int, p double"))
    bounds = [tuple(r) for r in cdf.select("word", "feat", "low", "high").collect()]
    made = Counter()
    for d, w, _, _, c in rows:
        for k in range(1, (c or 0) + 1 if w in p else 0):
            u = int(hashlib.md5("|".join(str(x) for x in (42, d, w, k) if x is not None).encode()).hexdigest()[:8], 16) / 2**32
            made.update((d, w, f, 0) for v, f, low, high in bounds if v == w and low <= u < high)
    wanted = Counter((*k, n) for k, n in made.items()) + Counter(r for r in rows if r[1] not in p)
    for size in ({}, {"draws": 7, "shares": 2}):
        found = corpus.inject_features(corpus_, cdf, **size)
        assert Counter(map(tuple, found.collect())) == wanted
        assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "int", "int", "int"]


def test_gamma_draws_of_many_entries_have_their_moments_and_depend_on_their_keys_alone():
    for shape in (0.05, 0.6, 1.0, 4.0, 300.0):
        x = standard_gammas(np.full((40_000, 5), shape), 42, 1, 0, np.arange(40_000))
        assert abs(x.mean() - shape) < 5 * (shape / x.size) ** 0.5
        assert abs(x.var() - shape) < 0.05 * shape
        assert np.abs(np.corrcoef(x.T) - np.eye(5)).max() < 0.03
        assert abs(np.corrcoef(x[1:, 0], x[:-1, 0])[0, 1]) < 0.03
    shapes, kinds, ids = np.random.default_rng(3).uniform(0.1, 9, (500, 3)), np.arange(500) % 3, np.arange(500) * 7
    whole = standard_gammas(shapes, 42, 2, kinds, ids)
    some = np.array([400, 3, 77])
    assert np.array_equal(whole[some], standard_gammas(shapes[some], 42, 2, kinds[some], ids[some]))
    assert not np.isclose(whole, standard_gammas(shapes, 42, 3, kinds, ids)).any()


def test_completion_takes_memory_by_its_known_cells(spark):
    rng = np.random.default_rng(5)
    i, j = rng.permutation(30_000)[:2000], rng.permutation(30_000)[:2000]
    tracemalloc.start()
    u, v = factor.complete_cells(i, j, np.full(2000, 2.0), (30_000, 30_000), 1, 50, rate=0.1, tolerance=0.0)
    assert tracemalloc.get_traced_memory()[1] < 20e6  # all cells would be 7.2e9
    tracemalloc.stop()
    assert u.shape == (30_000, 1) and np.abs(u[i, 0] * v[0, j] - 2).max() < 0.1

    rows = [(t, f"c{i % 3}", f"h{i}", s, float((s * 3 + i * t) % 5)) for t in (1, 2) for s in range(9) for i in range(7) if (s + i) % 4]
    rows += [(1, None, "h1", 1, 3.0), (2, "c0", "h0", 1, None), (2, "c9", "h9", 50, None)]
    df = spark.createDataFrame(rows, "trial int, compound string, const string, subject long, rating double")
    found = factor.completion_factors(df, 2, [("trial", "int")], 200, 0.01).collect()
    assert len(found) == 2 * 2 * (7 + 9)
    for t in (1, 2):
        matrix = np.full((7, 9), np.nan)
        for r in rows:
            if r[0] == t and r[1] and r[4] is not None:
                matrix[int(r[2][1:]), r[3]] = r[4]
        u, v = factor.complete_rank(matrix, 2, 200, 0.01)
        for r in found:
            if r["trial"] == t:
                assert r["value"] == pytest.approx(u[int(r["const"][1:]), r["k"] - 1] if r["side"] == "item" else v[r["k"] - 1, int(r["subject"])], abs=1e-9)
