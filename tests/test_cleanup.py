"""Cleaning under many settings at once equals cleaning under one at a time."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wordloom.functions.columns import uniform
from wordloom.operators import cleanup, factor, noise
from wordloom.operators import ratings as R
from wordloom.operators.cleanup import cleaned, cleanup_grid, grid_settings, standard_cleanup


def study(spark, consts=("h", "m"), compounds=6, people=5, seed=1):
    grid = spark.range(compounds).select(F.concat(F.lit("c"), "id").alias("compound")).crossJoin(spark.createDataFrame([(c,) for c in consts], "const string"))
    rows = grid.crossJoin(spark.range(people).select(F.concat(F.lit("s"), "id").alias("subject")))
    value = F.floor(uniform(f"{seed}item", "compound") * 5) + 1 + F.floor(uniform(seed, "compound", "const", "subject") * 3)
    return rows.withColumn("rating", value.cast("double")).filter(uniform(f"{seed}gone", "compound", "const", "subject") < 0.9)


def found(df, *names):
    return sorted(map(tuple, df.select(*(names or R.COLUMNS)).collect()))


SETTINGS = {"b": ("none", 0.0), "r": ("min_rho", 0.75), "z": ("zscore", 1.0), "n": ("drop", 2), "p": ("drop_share", 0.3)}


def test_settings_are_kept_apart(spark):
    rows = study(spark)
    out = cleaned(rows, SETTINGS)
    single = {"b": rows, "r": R.drop_deviant_subjects(rows, 0.75), "z": R.drop_deviant_ratings(rows, 1.0), "n": R.drop_worst_subjects(rows, 2), "p": R.drop_worst_subjects(rows, share=0.3)}
    sizes = set()
    for name, df in single.items():
        assert found(out.filter(F.col("setting") == name)) == found(df), name
        sizes.add(df.count())
    assert len(sizes) > 2  # the settings do differ


def test_trials_are_kept_apart(spark):
    rows = noise.offset(noise.trials(study(spark), 3), 0.4)
    out = cleaned(rows, SETTINGS)
    for t in (1, 2, 3):
        alone = cleaned(rows.filter(F.col("trial") == t).drop("trial"), SETTINGS)
        assert found(out.filter(F.col("trial") == t), "setting", *R.COLUMNS) == found(alone, "setting", *R.COLUMNS)


def test_low_ranks(spark):
    rows = study(spark, people=4)
    out = cleaned(rows, {"one": ("svd", 1), "two": ("svd", 2)}, epochs=200)
    for name, k in (("one", 1), ("two", 2)):
        alone = factor.by_svd(k, 200).clean(rows)
        a = {r[:3]: r[3] for r in found(out.filter(F.col("setting") == name))}
        b = {r[:3]: r[3] for r in found(alone)}
        assert a.keys() == b.keys() and all(abs(a[c] - b[c]) < 1e-9 for c in a)


def test_grid_of_settings(spark):
    parts, whole = study(spark), study(spark, ("whole",), seed=2)
    links = parts.select("compound", "const").distinct().withColumn("jaccard", uniform(3, "compound", "const"))
    links = links.unionByName(links.limit(1).select("compound", F.col("compound").alias("const"), F.lit(1.0).alias("jaccard")))
    rows = cleanup_grid(parts, whole, links, grid_settings([0.5], [1.0])).collect()
    assert {(r["setting"], r["variable"]) for r in rows} == {(s, v) for s in ("baseline", "min_rho=0.5", "zscore=1") for v in ("parts_cleaned", "parts_and_whole_cleaned", "whole_cleaned", "associations_indiv", "associations_whole")}
    value = {(r["setting"], r["variable"]): r["value"] for r in rows}
    assert all(r["retained_both"] == 1 for r in rows if r["setting"] == "baseline")
    base = R.compare(parts, whole, ("prod",)).first()["rho"]
    assert abs(value["baseline", "parts_cleaned"] - base) < 1e-9
    z = R.compare(R.drop_deviant_ratings(parts, 1.0), whole, ("prod",)).first()["rho"]
    assert abs(value["zscore=1", "parts_cleaned"] - z) < 1e-9
    kept = R.retained(parts, R.drop_deviant_ratings(parts, 1.0)).first()["retained"]
    assert {round(r["retained_indiv"], 9) for r in rows if r["setting"] == "zscore=1"} == {round(kept, 9)}


def test_unknown_names(spark):
    with pytest.raises(ValueError, match="no such cleaning"):
        cleaned(study(spark), {"x": ("whiten", 1)})
    with pytest.raises(ValueError, match="no grid"):
        noise.grid("pca", None, None)


def test_standard_cleanup(spark):
    a, b, whole = study(spark), study(spark, ("x",)), study(spark, ("whole",), seed=2)
    out = standard_cleanup([a, b], 0.5, 1.5, whole)
    step = R.drop_deviant_ratings(R.drop_deviant_subjects(a.unionByName(b), 0.5), 1.5)
    assert found(out["ratings"]) == found(step)
    assert out["aggregate"].count() == step.select("compound", "const").distinct().count()
    assert {r["method"] for r in out["against_whole"].collect()} == {"sum", "prod"}
    assert set(standard_cleanup([a])) == {"ratings", "aggregate"}


def test_cleaners_one_by_one(spark):
    parts, whole = study(spark), study(spark, ("whole",), seed=2)
    cleaners = [R.baseline(), R.by_min_rho(0.5), R.by_zscore(1.0), R.by_rebin("1122233"), R.by_fill(0.0)]
    rows = R.evaluate_cleaners(parts, whole, cleaners, "gmean").collect()
    assert [r["cleaner"] for r in rows] == ["baseline", "min_rho", "zscore", "rebin", "fill"]
    assert rows[0]["retained"] == 1 and rows[2]["retained"] < 1 and rows[4]["retained"] > 1
    assert rows[1]["parameters"] == "{'min_rho': 0.5}"
    scores = R.by_fill(0.0).scores(parts).collect()
    assert len(scores) == 6 and all(r["mean"] >= 0 for r in scores)


@pytest.mark.parametrize("grid", [("zscore", noise.offset, [0.3], [1.0], 2), ("svd", noise.blank, [0.2], [1], 2, 50), ("minrho", [1], 2), ("dropsubj", [0.3], 2)])
def test_noise_grids(spark, grid):
    parts, whole = study(spark), study(spark, ("whole",), seed=2)
    rows = noise.grid(grid[0], parts, whole, *grid[1:]).collect()
    assert {r["variable"] for r in rows} >= {*noise.COMPARED, "indiv_clean_notblank", "whole_noisy_notblank"}
    assert all(r["trials"] == 2 for r in rows)
    value = {(r["cleaner"], r["variable"]): r["mean"] for r in rows}
    if grid[0] == "zscore":  # without cleaning, cleaned parts of the original are the original parts
        assert value["none", "clean_cleanorig"] == value["none", "noisy_orig"]


def test_names_of_settings():
    assert list(grid_settings([0.1], [1.25], [3])) == ["baseline", "min_rho=0.1", "zscore=1.25", "svd_k=3"]
    assert {k for k, _ in grid_settings([1], [1], [1]).values()} <= set(cleanup.KINDS)


def test_low_rank_predictions(spark):
    """Hidden cells as by completing the visible matrix in numpy, for each rank."""
    import numpy as np

    rows = study(spark, people=6)
    split = noise.hold_out(rows, 4, 2)
    found = {(r["trial"], r["compound"], r["const"], r["subject"], r["rank"]): r["guess"] for r in noise.low_rank_predictions(split, [1, 3], 100).collect()}
    table = split.toPandas()
    assert {k[4] for k in found} == {1, 3}
    for trial, own in table.groupby("trial"):
        seen = own[~own["held"]].pivot_table(index=["compound", "const"], columns="subject", values="rating").sort_index().sort_index(axis=1)
        u, v = factor.complete_rank(seen.to_numpy(float), 3, 100)
        for r in own[own["held"]].itertuples():
            if (r.compound, r.const) in seen.index and r.subject in seen.columns:
                i, j = seen.index.get_loc((r.compound, r.const)), seen.columns.get_loc(r.subject)
                for k in (1, 3):
                    assert np.isclose(found[trial, r.compound, r.const, r.subject, k], u[i, :k] @ v[:k, j])


def test_errors_of_data_sets(spark):
    heads, mods, whole = study(spark, ("h",)), study(spark, ("m",), seed=4), study(spark, ("w",), seed=2)
    rows = noise.data_set_errors(heads, mods, whole, blanks=3, count=2, ranks=[1, 2], epochs=60).collect()
    assert {(r["data"], r["model"]) for r in rows} == {(d, m) for d in ("head", "mod", "whole", "both") for m in ("common", "item", "subject_mean", "item_subject", "svd1", "svd2")}
    assert all(r["mean"] >= 0 and r["trials"] == 2 for r in rows)
