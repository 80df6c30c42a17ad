"""Cleaning of rating studies under many settings at once: the setting is a key, not a plan of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wordloom.functions.scratch import stored
from wordloom.operators import ratings as R
from wordloom.operators.factor import completion_factors
from wordloom.operators.ranks import running
from wordloom.operators.stats import spearman

#: What a setting's number means: the least agreement, the widest z-score, subjects to drop, their share, the rank of an estimate.
KINDS = ("none", "min_rho", "zscore", "drop", "drop_share", "svd")


def grid_settings(rhos: list[float] = (), zscores: list[float] = (), ranks: list[int] = ()) -> dict[str, tuple[str, float]]:
    """No cleaning, and one setting for each value, by name."""
    out: dict[str, tuple[str, float]] = {"baseline": ("none", 0.0)}
    out |= {f"min_rho={r:g}": ("min_rho", r) for r in rhos} | {f"zscore={z:g}": ("zscore", z) for z in zscores}
    return out | {f"svd_k={k}": ("svd", k) for k in ranks}


def _agreements(ratings: DataFrame) -> DataFrame:
    """(run, subject, _rho, _place, _subjects): agreements at nine decimals, places from 1 by rising agreement, and how many subjects there are."""
    run = R.run_of(ratings)
    found = R.agreements(ratings).select(*run, "subject", F.round("rho", 9).alias("_rho"))
    if run:
        found = found.withColumn("_place", F.row_number().over(W.partitionBy(*run).orderBy("_rho", "subject")))
    else:
        found = running(found, ["_rho", "subject"], name="_place").withColumn("_place", F.col("_place") + 1)
    people = ratings.groupBy(*run).agg(F.count_distinct("subject").alias("_subjects"))
    return found.join(people, run) if run else found.crossJoin(F.broadcast(people))


def cleaned(ratings: DataFrame, settings: dict[str, tuple[str, float]], epochs: int = 10_000) -> DataFrame:
    """(setting, compound, const, subject, rating, and trial if there): what each setting leaves of the ratings.

    ``settings``: by name, a kind of KINDS and its number.  Agreements and the
    sums of items are worked out once; each rating then stays under the
    settings that keep it.
    """
    run, kinds = R.run_of(ratings), {k for k, _ in settings.values()}
    if unknown := kinds - {*KINDS}:
        raise ValueError(f"no such cleaning: {', '.join(sorted(unknown))}")
    rows = ratings.select(*run, *R.COLUMNS)
    x = F.col("rating")
    if "zscore" in kinds:
        item = W.partitionBy(*run, *R.ITEM)
        sums = {"_n": F.count(x), "_s": F.sum(x), "_q": F.sum(x * x), "_low": F.min(x), "_high": F.max(x)}
        rows = rows.withColumns({c: f.over(item) for c, f in sums.items()})
    if kinds & {"min_rho", "drop", "drop_share"}:
        rows = rows.join(_agreements(ratings), [*run, "subject"], "left")
    n, s, q = F.col("_n"), F.col("_s"), F.col("_q")

    def keeps(kind: str, value: float) -> Column:
        if kind == "zscore":  # as drop_deviant_ratings
            return (F.col("_low") < F.col("_high")) & ((n * x - s) * (n * x - s) * (n - 1) <= n * (n * q - s * s) * value**2) & F.lit(value >= 0)
        if kind == "min_rho":
            return F.coalesce(F.col("_rho") >= value, F.lit(True))
        if kind == "drop":
            return F.coalesce(F.col("_place") > value, F.lit(True))
        if kind == "drop_share":
            return F.coalesce(F.col("_place") > F.ceil(F.col("_subjects") * value), F.lit(True))
        return F.lit(True)

    direct = {name: keeps(*how) for name, how in settings.items() if how[0] != "svd"}
    out = []
    if direct:
        kept = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in direct.items())), lambda k: k.isNotNull())
        out.append(rows.select(F.explode(kept).alias("setting"), *run, *R.COLUMNS))
    ranks = {name: int(value) for name, (kind, value) in settings.items() if kind == "svd"}
    if ranks:
        typed = [(c, ratings.schema[c].dataType.simpleString()) for c in run]
        factors = stored(completion_factors(ratings, max(ranks.values()), typed, epochs))
        items = factors.filter("side = 'item'").select(*run, "k", *R.ITEM, F.col("value").alias("u"))
        people = factors.filter("side = 'subject'").select(*run, "k", "subject", F.col("value").alias("v"))
        reached = F.filter(F.array(*(F.struct(F.lit(name).alias("setting"), F.lit(k).alias("rank")) for name, k in ranks.items())), lambda r: r["rank"] >= F.col("k"))
        products = items.join(people, [*run, "k"]).select(*run, *R.ITEM, "subject", (F.col("u") * F.col("v")).alias("uv"), F.explode(F.transform(reached, lambda r: r["setting"])).alias("setting"))
        guess = products.groupBy("setting", *run, *R.ITEM, "subject").agg(F.sum("uv").alias("rating"))
        out.append(guess.withColumn("subject", F.col("subject").cast(ratings.schema["subject"].dataType)))
    return reduce(DataFrame.unionByName, out)


def cleanup_grid(parts: DataFrame, whole: DataFrame, associations: DataFrame, settings: dict[str, tuple[str, float]], method: str = "prod", epochs: int = 10_000) -> DataFrame:
    """(setting, retained_indiv, retained_whole, retained_both, variable, value): how cleaning moves five rank correlations.

    ``parts`` and ``whole``: ratings of constituents and of compounds;
    ``associations``: (compound, const, jaccard), a compound's own word left out.
    Only compounds of all three take part.  Parts of a compound are combined by
    ``method``, associations by the root of their product.  Variables: cleaned
    parts with wholes, with cleaned wholes, parts with cleaned wholes; cleaned
    parts with associations, and combined associations with cleaned wholes.
    """
    tables = R.restrict_to_common(parts.select(*R.COLUMNS), whole.select(*R.COLUMNS), associations.filter("compound <> const").select(*R.ITEM, "jaccard"))
    parts, whole, links = map(stored, tables)
    sums = lambda rows, *keys: stored(rows.groupBy(*keys, *R.ITEM).agg(F.avg("rating").alias("mean"), F.count("rating").alias("n")))
    p, w = sums(cleaned(parts, settings, epochs), "setting"), sums(cleaned(whole, settings, epochs), "setting")
    p0, w0 = sums(parts), sums(whole)

    combined = lambda means, how, value="mean": R.combine(means, how, value).withColumn("mean", F.round("mean", 9)).withColumnRenamed("mean", "x")
    wholes = lambda means: means.groupBy(*R.run_of(means), "compound").agg(F.round(F.avg("mean"), 9).alias("y"))

    together, whole_clean = combined(p, method), wholes(w)
    pairs = {
        "parts_cleaned": together.join(wholes(w0), "compound"),
        "parts_and_whole_cleaned": together.join(whole_clean, ["setting", "compound"]),
        "whole_cleaned": combined(p0, method).join(whole_clean, "compound"),
        "associations_indiv": p.join(links, [*R.ITEM]).select("setting", F.round("mean", 9).alias("x"), F.col("jaccard").alias("y")),
        "associations_whole": combined(links, "gmean", "jaccard").join(whole_clean, "compound"),
    }
    every = reduce(DataFrame.unionByName, (df.select("setting", F.lit(v).alias("variable"), "x", "y") for v, df in pairs.items()))
    rho = spearman(every, "x", "y", "setting", "variable").select("setting", "variable", F.col("rho").alias("value"))
    count = lambda df, name: df.groupBy("setting").agg(F.sum("n").alias(name))
    names = parts.sparkSession.createDataFrame([(s,) for s in settings], "setting string")
    totals = p0.agg(F.sum("n").alias("_p0")).crossJoin(w0.agg(F.sum("n").alias("_w0")))
    left = names.join(count(p, "_p"), "setting", "left").join(count(w, "_w"), "setting", "left").na.fill(0).crossJoin(F.broadcast(totals))
    share = lambda a, b: a / F.nullif(b, F.lit(0)).cast("double")
    shares = left.select("setting", share(F.col("_p"), F.col("_p0")).alias("retained_indiv"), share(F.col("_w"), F.col("_w0")).alias("retained_whole"), share(F.col("_p") + F.col("_w"), F.col("_p0") + F.col("_w0")).alias("retained_both"))
    return shares.join(rho, "setting")


def standard_cleanup(inputs: list[DataFrame], min_rho: float | None = None, zscore: float | None = None, whole: DataFrame | None = None) -> dict[str, DataFrame]:
    """Cleaned ratings, their aggregate and, given ratings or means of wholes, how well sums and products of parts agree with those.

    Subjects of low agreement leave first, then ratings far from their item's
    mean.  Only compounds of both sides are compared.
    """
    rows = reduce(DataFrame.unionByName, (i.select(*R.COLUMNS) for i in inputs))
    if min_rho is not None:
        rows = R.drop_deviant_subjects(rows, min_rho)
    if zscore is not None:
        rows = R.drop_deviant_ratings(rows, zscore)
    rows = stored(rows)
    out = {"ratings": rows, "aggregate": R.aggregate(rows)}
    if whole is not None:
        means = whole if "mean" in whole.columns else R.aggregate(whole)
        y = means.groupBy("compound").agg(F.round(F.avg("mean"), 9).alias("y"))
        each = [R.combine(out["aggregate"], m).select(F.lit(m).alias("method"), "compound", F.round("mean", 9).alias("x")).join(y, "compound") for m in ("sum", "prod")]
        out["against_whole"] = spearman(reduce(DataFrame.unionByName, each), "x", "y", "method")
    return out
