"""Ranks, correlations, weighted summaries and significance."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StructField, StructType

from wordloom.functions.columns import divide, uniform
from wordloom.operators.ranks import midranks, ordered_alike, percentiles, rank_correlation


def midrank(value: Column | str, *group: Column | str, descending: bool = False) -> Column:
    """Rank within the group, ties sharing the mean of their ranks."""
    value = F.col(value) if isinstance(value, str) else value
    order = value.desc() if descending else value.asc()
    return F.rank().over(W.partitionBy(*group).orderBy(order)) + (F.count("*").over(W.partitionBy(*group, value)) - 1) / F.lit(2.0)


def percentile_rank(df: DataFrame, value: str, *group: str, descending: bool = False, name: str = "pct") -> DataFrame:
    """Share of the group at or below a value (at or above, if descending), half ranks rounded up.

    Groups are ranked by windows; without one, ranks are worked out by ranges of
    the whole table, and rows without a value leave.
    """
    if not group:
        ranked = midranks(df, value, name="_rank")
        size = F.col("_size")
        number = F.ceil(size + 1 - F.col("_rank")) if descending else F.ceil("_rank")
        sized = ranked.crossJoin(F.broadcast(df.agg(F.count(value).alias("_size"))))
        return sized.withColumn(name, number.cast("double") / size).drop("_rank", "_size")
    size = F.count("*").over(W.partitionBy(*group))
    rank = midrank(value, *group)
    number = F.ceil(size + 1 - rank) if descending else F.ceil(rank)
    return df.withColumn(name, number.cast("double") / size)


def moments_rho(x: str, y: str) -> Column:
    """Pearson correlation from sums, null for a constant side (unlike corr, which then fails)."""
    n, sx, sy = F.count("*").cast("double"), F.sum(x), F.sum(y)
    num = n * F.sum(F.col(x) * F.col(y)) - sx * sy
    den = (n * F.sum(F.col(x) * F.col(x)) - sx * sx) * (n * F.sum(F.col(y) * F.col(y)) - sy * sy)
    return num / F.nullif(F.sqrt(F.greatest(den, F.lit(0.0))), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, *group: str, undefined: float | None = -1.0) -> DataFrame:
    """(group..., rho, n) over the rows with both values; an undefined rho becomes ``undefined`` (Q12).

    Groups are ranked by windows, as they are subjects, trials or word pairs;
    for groups of any size, and without one, see ``ranks.rank_correlation``.
    """
    if not group:
        return rank_correlation(df, x, y, undefined=undefined)
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = both.select(*group, midrank(x, *group).alias("_x"), midrank(y, *group).alias("_y"))
    out = ranks.groupBy(*group).agg(moments_rho("_x", "_y").alias("rho"), F.count("*").alias("n"))
    return out if undefined is None else out.withColumn("rho", F.coalesce("rho", F.lit(undefined)))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, element by element; x lies within (0, 1)."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    scale = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    sure = lambda v: np.where(v == 0, 1e-300, v)
    c, d = np.ones_like(x), 1 / sure(1 - (a + b) * x / (a + 1))
    total = d.copy()
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / sure(1 + k * d), sure(1 + k / c)
            total *= c * d
        if (np.abs(c * d - 1) < 1e-14).all():
            break
    return np.where(flip, 1 - scale * total, scale * total)


def t_two_sided(t: np.ndarray | float, df: np.ndarray | float) -> np.ndarray:
    """Probability that a t variable lies at least so far from 0."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    x = df / (df + t * t)
    inside = (x > 0) & (x < 1)
    return np.where(inside, _incomplete_beta(df / 2, np.full_like(df, 0.5), np.where(inside, x, 0.5)), (x >= 1).astype(float))


@F.pandas_udf(DoubleType())
def spearman_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a rank correlation, by the t distribution; null below 3 rows."""
    r, k = rho.to_numpy(float, na_value=np.nan), n.to_numpy(float, na_value=np.nan)
    known, edge = ~np.isnan(r) & (k >= 3), np.abs(r) >= 1
    safe, rest = np.where(known & ~edge, r, 0.0), np.where(known, k - 2, 1.0)
    p = np.where(edge, 0.0, t_two_sided(safe * np.sqrt(rest / (1 - safe * safe)), rest))
    return pd.Series(np.where(known, p, np.nan)).replace({np.nan: None}).astype("Float64")


def column_correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(left, right, rho, n) for all pairs of numeric columns, in one plan; the rows of a pair are ranked by ranges."""
    numeric = columns or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")]
    pairs = list(itertools.combinations(numeric, 2))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs)))
    return rank_correlation(df.select(each.alias("e")).select("e.*"), "x", "y", "left", "right")


def weighted_summary(df: DataFrame, value: str, count: str, *group: str, shares: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """Mean, population deviation and percentiles of values that each occur ``count`` times."""
    v, c = F.col(value), F.col(count)
    mean = divide(F.sum(v * c), F.sum(c).cast("double"))
    spread = F.sqrt(F.greatest(divide(F.sum(v * v * c), F.sum(c).cast("double")) - mean * mean, F.lit(0.0)))
    out = df.groupBy(*group).agg(F.sum(c).alias("n"), mean.alias("mean"), spread.alias("std"))
    places = percentiles(df, value, count, *group, shares=shares)
    if not group:
        return out.crossJoin(F.broadcast(places))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    return out.alias("a").join(places.alias("b"), same, "left").select(*(f"a.{c}" for c in out.columns), *(f"b.{c}" for c in places.columns if c not in group))


def t_quantile(share: float, df: np.ndarray | float) -> np.ndarray:
    """The t value that leaves ``share`` of the probability outside on both sides, for whole arrays of degrees of freedom."""
    df = np.asarray(df, float)
    low, high = np.zeros(df.shape), np.full(df.shape, 1e6)
    for _ in range(100):
        mid = (low + high) / 2
        outside = t_two_sided(mid, df) > share
        low, high = np.where(outside, mid, low), np.where(outside, high, mid)
    return high


def mean_interval(mean: np.ndarray | float, variance: np.ndarray | float, n: np.ndarray | int, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Bayesian interval of a mean: t for up to 1000 values, else normal; single numbers or whole arrays."""
    n = np.asarray(n, float)
    sizes, place = np.unique(np.where(n > 1000, 0, n), return_inverse=True)
    normal = NormalDist().inv_cdf(0.5 + level / 2)
    quantile = np.where(sizes == 0, normal, t_quantile(1 - level, np.maximum(sizes - 1, 1)))[place].reshape(n.shape)
    half = quantile * np.sqrt(np.asarray(variance, float) / n)
    return np.asarray(mean, float) - half, np.asarray(mean, float) + half


def interval_at(level: float) -> Callable[..., Column]:
    """``mean_interval`` at a level for columns (mean, variance, n), as a struct of low and high; null without values."""

    @F.pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
    def interval(mean: pd.Series, variance: pd.Series, n: pd.Series) -> pd.DataFrame:
        m, v, k = (x.to_numpy(float, na_value=np.nan) for x in (mean, variance, n))
        known = ~np.isnan(m) & ~np.isnan(v) & (k > 1)
        low, high = mean_interval(np.where(known, m, 0.0), np.where(known, v, 1.0), np.where(known, k, 2.0), level)
        blank = lambda x: pd.Series(np.where(known, x, np.nan)).replace({np.nan: None}).astype("Float64")
        return pd.DataFrame({"low": blank(low), "high": blank(high)})

    return interval


interval_of = interval_at(0.95)


def trial_summary(df: DataFrame, value: str, *group: str) -> DataFrame:
    """mean, std, low and high (two deviations) and the number of trials."""
    out = df.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("trials"))
    return out.withColumns({"low": F.col("mean") - 2 * F.col("std"), "high": F.col("mean") + 2 * F.col("std")})


def confidence_band(df: DataFrame, mean: str = "mean", std: str = "std", trials: str = "trials") -> DataFrame:
    """Two standard errors about a mean."""
    half = 2 * F.col(std) / F.sqrt(F.col(trials).cast("double"))
    return df.withColumns({"band_low": F.col(mean) - half, "band_high": F.col(mean) + half})


def randomization_test(outputs: DataFrame, trials: int = 1000, seed: int = 42, evaluate: Callable[[Column], Column] = F.avg) -> DataFrame:
    """Approximate randomization over (id, out1, out2): observed difference, hits, p.

    In each trial every pair is swapped by a coin that depends on the trial and
    the id only.  ``evaluate`` turns a column into an aggregate.  The trials are
    dealt out with the rows and sums are combined before the shuffle, so there
    is one row for each trial and task afterwards.
    """
    rows = outputs.select("id", F.col("out1").cast("double").alias("out1"), F.col("out2").cast("double").alias("out2"))
    observed = rows.agg((evaluate(F.col("out1")) - evaluate(F.col("out2"))).alias("observed"))
    dealt = rows.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    coin = uniform(seed, "trial", "id") < 0.5
    swapped = dealt.select("trial", F.when(coin, F.col("out2")).otherwise(F.col("out1")).alias("a"), F.when(coin, F.col("out1")).otherwise(F.col("out2")).alias("b"))
    deltas = swapped.groupBy("trial").agg((evaluate(F.col("a")) - evaluate(F.col("b"))).alias("delta"))
    hit = F.abs("delta") >= F.abs("observed") - 1e-12
    counted = deltas.crossJoin(F.broadcast(observed)).groupBy("observed").agg(F.count_if(hit).alias("hits"), F.count("*").alias("trials"))
    return counted.withColumn("p", (F.col("hits") + 1) / (F.col("trials") + 1).cast("double"))


def order_accuracy(gold: DataFrame, measures: list[str], gap: float = 1.0, key: str = "id", rating: str = "gold") -> DataFrame:
    """(measure, pairs, accuracy, baseline): shares of gold pairs, at least ``gap`` apart, that a measure orders alike.

    A pair is ordered alike if, the smaller key first, gold rises exactly where
    the measure rises; ``baseline`` is the share of pairs whose gold rises.  Pairs
    are counted by ranks and prefix counts, never listed.
    """
    each = F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures)))
    found = ordered_alike(gold.select(F.col(key).alias("key"), F.col(rating).cast("double").alias("gold"), each), gap, "measure")
    share = lambda c: F.col(c) / F.col("pairs").cast("double")
    return found.filter("pairs > 0").select("measure", "pairs", share("hits").alias("accuracy"), share("first_less").alias("baseline"))


def rmse(df: DataFrame, truth: str, guess: str, *group: str) -> DataFrame:
    return df.groupBy(*group).agg(F.sqrt(F.avg(F.pow(F.col(truth) - F.col(guess), 2))).alias("rmse"), F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, density) over equal bins; the last one holds its upper border."""
    width = (high - low) / bins
    inside = df.filter(F.col(value).between(low, high)).select(F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = inside.groupBy("bin").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") / F.col("total") / width).alias("density"))
