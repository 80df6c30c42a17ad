"""Noise for rating studies, and the experiments built on it.

Every random choice hangs on a seed and on the keys of the cell, so results do
not depend on partitions and trials can run side by side in one plan.  With a
``trial`` column in the ratings, each trial draws for itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wordloom.functions.columns import divide, uniform, wrap
from wordloom.functions.scratch import stored
from wordloom.operators import ratings as R
from wordloom.operators.cleanup import cleaned
from wordloom.operators.stats import rmse, spearman, trial_summary


def _keys(df: DataFrame, *names: str) -> list[str]:
    return [*(["trial"] if "trial" in df.columns else []), *names]


def random_rating(draw: Column, low: int = 1, size: int = 7) -> Column:
    return (low + F.floor(draw * size)).cast("double")


def randomize(ratings: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Each cell of the full grid becomes a random rating with probability ``share``, blanks too (Q18)."""
    cell = _keys(ratings, *R.ITEM, "subject")
    hit = uniform(f"{seed}a", *cell) < share
    return R.complete(ratings).withColumn("rating", F.when(hit, random_rating(uniform(f"{seed}b", *cell))).otherwise(F.col("rating"))).filter("rating IS NOT NULL")


def offset(ratings: DataFrame, share: float, by: int = 3, seed: int = 42) -> DataFrame:
    """Each rating is moved by ``by`` up or down, around the ends, with probability ``share``."""
    cell = _keys(ratings, *R.ITEM, "subject")
    sign = F.when(uniform(f"{seed}b", *cell) < 0.5, by).otherwise(-by)
    return ratings.withColumn("rating", F.when(uniform(f"{seed}a", *cell) < share, wrap(F.col("rating") + sign)).otherwise(F.col("rating")))


def blank(ratings: DataFrame, share: float, seed: int = 42) -> DataFrame:
    return ratings.filter(uniform(f"{seed}a", *_keys(ratings, *R.ITEM, "subject")) >= share)


def add_subjects(ratings: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """``count`` made-up subjects who rate every item at random."""
    fake = F.explode(F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.concat(F.lit("fake"), i.cast("string")))) if count else None
    if fake is None:
        return ratings
    keys = _keys(ratings, *R.ITEM)
    made = ratings.select(*keys).distinct().withColumn("subject", fake)
    made = made.withColumn("rating", random_rating(uniform(f"{seed}b", *keys, "subject")))
    return ratings.withColumn("subject", F.col("subject").cast("string")).unionByName(made)


def chosen_subjects(ratings: DataFrame, count: int | None = None, share: float | None = None, seed: int = 42) -> DataFrame:
    """``count`` subjects, or a share of them rounded up (Q17), in a random order."""
    own = _keys(ratings, "subject")
    subjects = ratings.select(*own).distinct().withColumn("_u", uniform(f"{seed}s", *own))
    group = _keys(ratings)
    place = F.row_number().over(W.partitionBy(*group).orderBy("_u", "subject"))
    most = F.lit(count) if share is None else F.ceil(F.count("*").over(W.partitionBy(*group)) * share)
    return subjects.withColumns({"_k": place, "_n": most}).filter("_k <= _n").select(*own)


def replace_subjects(ratings: DataFrame, count: int | None = None, share: float | None = None, seed: int = 42) -> DataFrame:
    """The chosen subjects rate every item at random."""
    chosen = chosen_subjects(ratings, count, share, seed)
    keys = _keys(ratings, *R.ITEM)
    group = _keys(ratings)
    items = ratings.select(*keys).distinct()
    made = (items.join(chosen, group) if group else items.join(chosen, F.lit(True))).withColumn("rating", random_rating(uniform(f"{seed}b", *keys, "subject")))
    return ratings.join(chosen, [*group, "subject"], "left_anti").unionByName(made, allowMissingColumns=True)


def blank_subjects(ratings: DataFrame, count: int | None = None, share: float | None = None, seed: int = 42) -> DataFrame:
    return ratings.join(chosen_subjects(ratings, count, share, seed), _keys(ratings, "subject"), "left_anti")


def trials(ratings: DataFrame, count: int) -> DataFrame:
    return ratings.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(count))))


# What a trial compares, by name: versions of the parts' combined means (p) and of the whole means (w).
COMPARED = {
    "noisy_noisy": ("p_noisy", "w_noisy"), "clean_noisy": ("p_clean", "w_noisy"), "noisy_clean": ("p_noisy", "w_clean"), "clean_clean": ("p_clean", "w_clean"),
    "noisy_orig": ("p_noisy", "w_orig"), "clean_orig": ("p_clean", "w_orig"), "orig_noisy": ("p_orig", "w_noisy"), "orig_clean": ("p_orig", "w_clean"),
    "orig_orig": ("p_orig", "w_orig"), "cleanorig_orig": ("p_cleanorig", "w_orig"), "cleanorig_noisy": ("p_cleanorig", "w_noisy"), "cleanorig_clean": ("p_cleanorig", "w_clean"),
    "orig_cleanorig": ("p_orig", "w_cleanorig"), "noisy_cleanorig": ("p_noisy", "w_cleanorig"), "clean_cleanorig": ("p_clean", "w_cleanorig"),
}


def experiment(parts: DataFrame, whole: DataFrame, noise: Callable[[DataFrame], DataFrame], settings: dict[str, tuple[str, float]], count: int = 100, epochs: int = 10_000) -> DataFrame:
    """(cleaner, variable, mean, std, trials, low, high) over ``count`` trials of noisy and cleaned ratings.

    Both the parts and the wholes get noise and are cleaned, and so are the
    original ratings.  Variables are the rank correlations of COMPARED (Q19) and
    the numbers of ratings (``_notblank``) of parts (indiv) and wholes.  All trials
    and all settings (see ``cleanup.cleaned``) are keys of one plan: noise is drawn
    once, and each side is scored once by trial and setting.
    """
    score = {"p": lambda r: R.combine(r, "gmean"), "w": lambda r: r.groupBy(*R.run_of(r), "compound").agg(F.avg("mean").alias("mean"))}
    every = {"setting": F.explode(F.array(*map(F.lit, settings))), "trial": F.explode(F.sequence(F.lit(1), F.lit(count)))}
    scores, counts = [], []
    for side, label, original in (("p", "indiv", parts), ("w", "whole", whole)):
        original = stored(original.select(*R.COLUMNS))
        noisy = stored(noise(trials(original, count)).select("trial", *R.COLUMNS))
        versions = {"orig": original, "cleanorig": cleaned(original, settings, epochs), "noisy": noisy, "clean": cleaned(noisy, settings, epochs)}
        for version, rows in versions.items():
            keys = [c for c in every if c in rows.columns]
            means = stored(rows.groupBy(*keys, *R.ITEM).agg(F.avg("rating").alias("mean"), F.count("rating").alias("n")))
            for out, df in ((scores, score[side](means).select(*keys, "compound", F.lit(f"{side}_{version}").alias("version"), F.round("mean", 9).alias("mean"))), (counts, means.groupBy(*keys).agg(F.sum("n").cast("double").alias("value")).select(*keys, F.lit(f"{label}_{version}_notblank").alias("variable"), "value"))):
                if out is counts and version == "cleanorig":
                    continue
                for name in every:
                    df = df if name in keys else df.withColumn(name, every[name])
                out.append(df)
    both = reduce(DataFrame.unionByName, scores)
    names = sorted({v for pair in COMPARED.values() for v in pair})
    wide = both.groupBy("setting", "trial", "compound").agg(*(F.max(F.when(F.col("version") == v, F.col("mean"))).alias(v) for v in names))
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("variable"), F.col(x).alias("x"), F.col(y).alias("y")) for k, (x, y) in COMPARED.items())))
    rho = spearman(wide.select("setting", "trial", each), "x", "y", "setting", "trial", "variable").select("setting", "trial", "variable", F.col("rho").alias("value"))
    return trial_summary(reduce(DataFrame.unionByName, counts, rho), "value", "setting", "variable").withColumnRenamed("setting", "cleaner")


Noise = Callable[[DataFrame, float], DataFrame]


def zscore_grid(parts: DataFrame, whole: DataFrame, noise: Noise, shares: list[float], thresholds: list[float], count: int = 100) -> DataFrame:
    """The experiment over noise shares (column p_noise, Q20) and z-score thresholds; "none" leaves ratings as they are."""
    settings = {"none": ("none", 0.0)} | {f"z{z}": ("zscore", z) for z in thresholds}
    return _stacked(("p_noise", p, experiment(parts, whole, lambda r, p=p: noise(r, p), settings, count)) for p in shares)


def svd_grid(parts: DataFrame, whole: DataFrame, noise: Noise, shares: list[float], ranks: list[int], count: int = 100, epochs: int = 10_000) -> DataFrame:
    """The experiment over noise shares and low ranks by which all ratings are estimated."""
    settings = {"none": ("none", 0.0)} | {f"svd{k}": ("svd", k) for k in ranks}
    return _stacked(("p_noise", p, experiment(parts, whole, lambda r, p=p: noise(r, p), settings, count, epochs)) for p in shares)


def min_rho_grid(parts: DataFrame, whole: DataFrame, numbers: list[int], count: int = 100, seed: int = 42) -> DataFrame:
    """As many subjects made random as are dropped for their low agreement (column n)."""
    return _stacked(("n", n, experiment(parts, whole, lambda r, n=n: replace_subjects(r, n, seed=seed), {"minrho": ("drop", n)}, count)) for n in numbers)


def drop_subject_grid(parts: DataFrame, whole: DataFrame, shares: list[float], count: int = 100, seed: int = 42) -> DataFrame:
    """The share of subjects made random is dropped for low agreement (column p)."""
    return _stacked(("p", p, experiment(parts, whole, lambda r, p=p: replace_subjects(r, share=p, seed=seed), {"devsubj": ("drop_share", p)}, count)) for p in shares)


GRIDS = {"zscore": zscore_grid, "svd": svd_grid, "minrho": min_rho_grid, "dropsubj": drop_subject_grid}


def grid(name: str, parts: DataFrame, whole: DataFrame, *args, **how) -> DataFrame:
    """One of GRIDS by its name."""
    if name not in GRIDS:
        raise ValueError(f"no grid {name!r}; there are {', '.join(GRIDS)}")
    return GRIDS[name](parts, whole, *args, **how)


def _stacked(runs: Iterable[tuple[str, float, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.withColumn(name, F.lit(value)) for name, value, df in runs))


def hold_out(ratings: DataFrame, blanks: int = 50, count: int = 100, seed: int = 42) -> DataFrame:
    """Ratings by trial with ``held``: true for the ``blanks`` cells that the trial hides (a cell's copies with it).

    Tasks keep their own least ``blanks`` cells of a trial, and the last of the
    least of all, one row a trial, bounds the others; no task sees a whole trial.
    """
    rows = trials(ratings, count).withColumn("_place", F.struct(uniform(seed, "trial", *R.ITEM, "subject").alias("u"), *R.ITEM, "subject"))
    order = W.partitionBy("trial").orderBy("_place")
    cells = rows.select("trial", "_place").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= blanks)
    last = cells.groupBy("trial").agg(F.max("_place").alias("_last"))
    held = F.coalesce(F.col("_place") <= F.col("_last"), F.lit(False))
    return rows.join(F.broadcast(last), "trial", "left").withColumn("held", held).drop("_place", "_last")


def predictions(split: DataFrame) -> DataFrame:
    """The hidden cells with guesses from the others: the commonest rating, item and subject means, and their root.

    Items or subjects without other ratings get the mean of all.
    """
    seen = split.filter(~F.col("held"))
    counts = seen.groupBy("trial", "rating").agg(F.count("*").alias("n"))
    mode = counts.groupBy("trial").agg(F.max_by("rating", F.struct("n", -F.col("rating"))).alias("common"))
    average = seen.groupBy("trial").agg(F.avg("rating").alias("_all"))
    item = seen.groupBy("trial", *R.ITEM).agg(F.avg("rating").alias("_item"))
    subject = seen.groupBy("trial", "subject").agg(F.avg("rating").alias("_subject"))
    rows = split.filter("held").join(mode, "trial").join(average, "trial").join(item, ["trial", *R.ITEM], "left").join(subject, ["trial", "subject"], "left")
    by_item, by_subject = F.coalesce("_item", "_all"), F.coalesce("_subject", "_all")
    return rows.select("trial", *R.COLUMNS, "common", by_item.alias("item"), by_subject.alias("subject_mean"), F.sqrt(by_item * by_subject).alias("item_subject"))


def low_rank_predictions(split: DataFrame, ranks: list[int], epochs: int = 10_000) -> DataFrame:
    """(trial, compound, const, subject, rating, rank, guess): the hidden cells by the first factors of the others' completion.

    Factors are nested, so they are fitted once for the largest rank and added
    up; only hidden cells are put together.  Cells of an item or a subject
    without other ratings leave.
    """
    from wordloom.operators.factor import completion_factors

    text = [F.col(c).cast("string").alias(c) for c in (*R.ITEM, "subject")]
    factors = stored(completion_factors(split.filter(~F.col("held")), max(ranks), [("trial", "int")], epochs))
    items = factors.filter("side = 'item'").select("trial", "k", *R.ITEM, F.col("value").alias("u"))
    people = factors.filter("side = 'subject'").select("trial", "k", "subject", F.col("value").alias("v"))
    cells = split.filter("held").select("trial", *text, "rating").join(items, ["trial", *R.ITEM]).join(people, ["trial", "k", "subject"])
    reached = F.sum(F.col("u") * F.col("v")).over(W.partitionBy("trial", *R.ITEM, "subject").orderBy("k"))
    return cells.select("trial", *R.ITEM, "subject", "rating", F.col("k").alias("rank"), reached.alias("guess")).filter(F.col("rank").isin(list(ranks)))


def prediction_errors(ratings: DataFrame, blanks: int = 50, count: int = 100, seed: int = 42, ranks: list[int] = (), epochs: int = 10_000) -> DataFrame:
    """(model, mean, std, trials, low, high) of the root mean squared errors by trial; with ``ranks``, models svd1 and so on too."""
    split = hold_out(ratings, blanks, count, seed)
    split = stored(split) if ranks else split
    each = F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("guess")) for m in ("common", "item", "subject_mean", "item_subject"))))
    guesses = predictions(split).select("trial", "rating", each)
    if ranks:
        low = low_rank_predictions(split, list(ranks), epochs)
        guesses = guesses.unionByName(low.select("trial", "rating", F.concat(F.lit("svd"), "rank").alias("model"), "guess"))
    return trial_summary(rmse(guesses, "rating", "guess", "model", "trial"), "rmse", "model")


def data_set_errors(heads: DataFrame, mods: DataFrame, whole: DataFrame, **how) -> DataFrame:
    """``prediction_errors`` with a column data: head, mod, whole, and both (heads and modifiers together); only compounds of all three."""
    heads, mods, whole = R.restrict_to_common(*(d.select(*R.COLUMNS) for d in (heads, mods, whole)))
    sets = {"head": heads, "mod": mods, "whole": whole, "both": heads.unionByName(mods)}
    return reduce(DataFrame.unionByName, (prediction_errors(d, **how).withColumn("data", F.lit(name)) for name, d in sets.items()))


def coverage(hits: DataFrame, total: str, found: str, *group: str) -> DataFrame:
    return hits.groupBy(*group).agg(divide(F.sum(found).cast("double"), F.sum(total).cast("double")).alias("coverage"))
