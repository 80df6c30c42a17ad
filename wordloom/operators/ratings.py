"""Rating studies in long form: rows (compound, const, subject, rating), no row for a blank."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wordloom.functions.columns import divide
from wordloom.functions.scratch import stored
from wordloom.functions.tiles import half_up, meet, tile_pairs, tiles_for
from wordloom.operators.ranks import running
from wordloom.operators.stats import spearman

ITEM = ("compound", "const")
COLUMNS = (*ITEM, "subject", "rating")


def run_of(ratings: DataFrame) -> list[str]:
    """The columns that part runs of one study, where there are any: each is then worked on for itself."""
    return [c for c in ("setting", "trial") if c in ratings.columns]


def long_form(wide: DataFrame) -> DataFrame:
    """Wide ratings (compound, const, and one column a subject, or ``cells`` of many) as rows; blanks and NaN leave."""
    subjects = [c for c in wide.columns if c not in ITEM]
    if dict(wide.dtypes).get("cells", "").startswith("map<"):
        rows = wide.select(*ITEM, F.explode("cells").alias("subject", "rating")).select(*ITEM, F.col("subject").cast("string").alias("subject"), F.col("rating").cast("double").alias("rating"))
    else:
        rows = wide.select(*ITEM, *(F.col(f"`{c}`").cast("double").alias(c) for c in subjects)).unpivot(list(ITEM), subjects, "subject", "rating")
    return rows.filter(F.col("rating").isNotNull() & ~F.isnan("rating"))


def wide_form(ratings: DataFrame, subjects: list) -> DataFrame:
    """One column for each of the given subjects, which must be few: every column is part of the plan."""
    return ratings.groupBy(*ITEM).pivot("subject", subjects).agg(F.first("rating"))


def wide_cells(ratings: DataFrame, width: int = 1024) -> DataFrame:
    """(compound, const, block, cells): wide ratings for any number of subjects, as maps from subject to rating.

    Subjects are dealt into blocks of about ``width``, which bounds the rows.
    An item has a row for each block that rated it; a subject's first rating counts.
    """
    blocks = max(1, -(-ratings.select("subject").distinct().count() // width))
    cells = ratings.filter(F.col("subject").isNotNull()).groupBy(*ITEM, "subject").agg(F.first("rating").alias("rating"))
    block = F.pmod(F.xxhash64("subject"), F.lit(blocks)).alias("block")
    return cells.groupBy(*ITEM, block).agg(F.map_from_entries(F.collect_list(F.struct("subject", "rating"))).alias("cells"))


def restrict_to_common(*tables: DataFrame, key: str = "compound") -> list[DataFrame]:
    """Each table's rows whose key occurs in all of them."""
    common = reduce(DataFrame.intersect, (t.select(key) for t in tables))
    return [t.join(common, key, "left_semi") for t in tables]


def aggregate(ratings: DataFrame) -> DataFrame:
    """(compound, const, n, mean, median, stddev, var); the spread of a single rating is 0 (Q11)."""
    out = ratings.groupBy(*run_of(ratings), *ITEM).agg(F.count("rating").alias("n"), F.avg("rating").alias("mean"), F.median("rating").alias("median"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("stddev"))
    return out.filter("n > 0").withColumn("var", F.col("stddev") * F.col("stddev"))


def combine(means: DataFrame, method: str = "gmean", value: str = "mean") -> DataFrame:
    """(compound, mean) from the means of a compound's constituents.

    gmean is the root of the product (Q15), hmean twice the product over the sum.
    """
    total, product = F.sum(value), F.product(value)
    forms = {"sum": total, "prod": product, "gmean": F.sqrt(product), "hmean": divide(2 * product, total)}
    return means.groupBy(*run_of(means), "compound").agg(forms[method].alias("mean"))


def with_others(ratings: DataFrame) -> DataFrame:
    """Ratings with ``others``, the mean of the item's other ratings; rows without others leave."""
    item = W.partitionBy(*run_of(ratings), *ITEM)
    others = (F.sum("rating").over(item) - F.col("rating")) / F.nullif(F.count("rating").over(item) - 1, F.lit(0))
    return ratings.withColumn("others", F.round(others, 9)).filter(F.col("others").isNotNull())


def agreements(ratings: DataFrame) -> DataFrame:
    """(subject, rho, n): rank correlation of a subject with the mean of the others."""
    return spearman(with_others(ratings), "rating", "others", *run_of(ratings), "subject")


def _without(ratings: DataFrame, subjects: DataFrame) -> DataFrame:
    key = [*run_of(ratings), "subject"]
    return ratings.join(subjects.select(*key), key, "left_anti").select(*run_of(ratings), *COLUMNS)


def drop_deviant_subjects(ratings: DataFrame, min_rho: float = 0.5) -> DataFrame:
    """Blank the subjects whose agreement is below ``min_rho``."""
    return _without(ratings, agreements(ratings).filter(F.col("rho") < min_rho))


def drop_worst_subjects(ratings: DataFrame, count: int | None = None, share: float | None = None) -> DataFrame:
    """Blank the ``count`` subjects, or the share rounded up, of least agreement; ties by subject."""
    found = agreements(ratings)
    if run := run_of(ratings):
        place = F.row_number().over(W.partitionBy(*run).orderBy("rho", "subject"))
        most = ratings.groupBy(*run).agg((F.lit(count) if share is None else F.ceil(F.count_distinct("subject") * share)).alias("_most"))
        return _without(ratings, found.withColumn("_place", place).join(most, run).filter("_place <= _most"))
    if share is not None:
        count = -int(-share * ratings.select("subject").distinct().count() // 1)
    return _without(ratings, found.orderBy("rho", "subject").limit(count))


def drop_deviant_ratings(ratings: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Keep ratings within ``threshold`` deviations of their item's mean.

    Items without spread, or with one rating, lose all of them (Q10).  The
    bound is compared in sums, squared and without divisions: exact for whole
    ratings, so one right at the bound stays whatever the order of the rows.
    """
    x, item = F.col("rating"), W.partitionBy(*run_of(ratings), *ITEM)
    sums = {"_n": F.count(x), "_s": F.sum(x), "_q": F.sum(x * x), "_low": F.min(x), "_high": F.max(x)}
    n, s, q = F.col("_n"), F.col("_s"), F.col("_q")
    far = (n * x - s) * (n * x - s) * (n - 1)
    scored = ratings.withColumns({c: f.over(item) for c, f in sums.items()})
    return scored.filter((F.col("_low") < F.col("_high")) & (far <= n * (n * q - s * s) * threshold**2) & F.lit(threshold >= 0)).select(*run_of(ratings), *COLUMNS)


def rebin(ratings: DataFrame, bins: dict[float, float] | list[float] | str) -> DataFrame:
    """Map ratings: a dict, a list or a string of digits for 1, 2, ...; others stay."""
    if not isinstance(bins, dict):
        bins = {float(k): float(v) for k, v in enumerate(bins, 1)}
    table = F.create_map(*(F.lit(float(x)) for kv in bins.items() for x in kv))
    return ratings.withColumn("rating", F.coalesce(F.element_at(table, F.col("rating")), F.col("rating")))


def complete(ratings: DataFrame) -> DataFrame:
    """All items by all subjects, blanks null.  The grid is the result's size, from two key lists."""
    run = run_of(ratings)
    grid = ratings.select(*run, *ITEM).distinct().join(ratings.select(*run, "subject").distinct(), run or F.lit(True))
    return grid.join(ratings, [*run, *ITEM, "subject"], "left").select(*run, *COLUMNS)


def fill(ratings: DataFrame, value: float = 0.0) -> DataFrame:
    """Blanks become a constant."""
    return complete(ratings).na.fill({"rating": value})


def retained(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: ratings before and after, and the share that is left."""
    a, b = before.agg(F.count("rating").alias("before")), after.agg(F.count("rating").alias("after"))
    return a.crossJoin(b).withColumn("retained", F.col("after") / F.nullif(F.col("before"), F.lit(0)))


def profile(ratings: DataFrame) -> DataFrame:
    """For each subject: n, range, quartiles, mean, deviation and how often each value 1 to 7 was given."""
    places = F.percentile("rating", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    counts = [F.count_if(F.col("rating") == k).alias(f"n{k}") for k in range(1, 8)]
    out = ratings.groupBy("subject").agg(F.count("rating").alias("n"), F.min("rating").alias("min"), F.max("rating").alias("max"), F.avg("rating").alias("mean"), F.stddev_samp("rating").alias("stddev"), places.alias("_p"), *counts)
    return out.select("subject", "n", "min", "max", *(F.get("_p", k).alias(c) for k, c in enumerate(("q1", "median", "q3"))), "mean", "stddev", *(f"n{k}" for k in range(1, 8)))


def _doubled_midranks(pair: np.ndarray, code: np.ndarray, pairs: int, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Twice the rank of each row within its pair (ties share), and for each pair the sum of their squares."""
    key = pair * codes + code
    if pairs * codes <= max(1 << 22, 4 * len(key)):
        held = np.arange(pairs * codes)
        place, counts = key, np.bincount(key, minlength=pairs * codes)
    else:
        held, place, counts = np.unique(key, return_inverse=True, return_counts=True)
    owner = held // codes
    before = np.cumsum(counts) - counts
    first = np.searchsorted(owner, np.arange(pairs))
    start = np.append(before, counts.sum())[first]
    ranks = 2.0 * (before - start[owner]) + counts + 1
    return ranks[place], np.bincount(owner, counts * ranks * ranks, pairs)


def _agreements_of(left: pa.Table, right: pa.Table, rows: int = 1 << 20) -> Iterator[pa.Table]:
    """(one, other, n, agreement, rho) for the pairs of a tile's subjects (subject, items, ratings).

    Pairs of values are counted by matrix products where values are few, else
    joint ratings are listed, about ``rows`` at a time; both are whole numbers.
    """
    same = left.column("a")[0].as_py() == left.column("b")[0].as_py()

    def cells(t: pa.Table) -> tuple:
        """Subjects in order, and for each rating its subject's place, item and value."""
        lists, names = t.column("items").combine_chunks(), t.column("subject").combine_chunks()
        order = pc.array_sort_indices(names).to_numpy()
        who = np.repeat(np.argsort(order), lists.value_lengths().to_numpy())
        by = np.argsort(who, kind="stable")
        return names.take(pa.array(order)), who[by], lists.flatten().to_numpy()[by], t.column("ratings").combine_chunks().flatten().to_numpy()[by]

    (ours, who, item, x), (others, other, their, y) = cells(left), cells(right)
    values = np.unique(np.concatenate([x, y]))
    order = np.argsort(their, kind="stable")
    other, their, x, y = other[order], their[order], np.searchsorted(values, x), np.searchsorted(values, y[order])
    low = np.searchsorted(their, item)
    counts = np.searchsorted(their, item, "right") - low
    items = np.unique(item[counts > 0])
    # a pair of values costs as many steps as there are items, of which a joint rating costs about a thousand
    if len(values) ** 2 * (len(items) + 40) * len(left) * len(right) <= 1000 * int(counts.sum()) and len(items) * len(values) * len(left) <= 1 << 25:
        ours_met, theirs_met = counts > 0, np.isin(their, items)
        one, two = (who[ours_met], np.searchsorted(items, item[ours_met]), x[ours_met]), (other[theirs_met], np.searchsorted(items, their[theirs_met]), y[theirs_met])
        sums = _counted(one, two, len(left), len(right), len(items), len(values), same)
    else:
        sums = _listed((who, x, low, counts), (other, y), len(left), len(right), len(values), same, rows)
    for i, j, n, equal, cross, xx, yy in sums:
        total = n * (n + 1)
        spread = np.sqrt(np.maximum((n * xx - total * total) * (n * yy - total * total), 0))
        rho = np.where(spread > 0, (n * cross - total * total) / np.where(spread > 0, spread, 1), -1.0)
        yield pa.table({"one": ours.take(pa.array(i)), "other": others.take(pa.array(j)), "n": pa.array(n.astype(np.int64)), "agreement": equal / n, "rho": rho})


def _listed(ours: tuple, theirs: tuple, subjects: int, wide: int, values: int, same: bool, rows: int) -> Iterator[tuple]:
    """(i, j, n, equal, cross, xx, yy) of pairs with joint ratings, from those ratings: the numbers of all and of equal ones, and the sums over doubled ranks."""
    (who, x, low, counts), (other, y) = ours, theirs
    starts = np.searchsorted(who, np.arange(subjects + 1))
    through = np.append(0, np.cumsum(counts))
    at = 0
    while at < subjects:
        # the subjects from ``at`` to ``end``: at least one
        end = max(at + 1, min(int(np.searchsorted(through[starts], through[starts[at]] + rows, "right")) - 1, at + rows // wide))
        part = slice(starts[at], starts[end])
        k = counts[part]
        hit = np.repeat(low[part] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        pair, one, two = np.repeat((who[part] - at) * wide, k) + other[hit], np.repeat(x[part], k), y[hit]
        if same:
            ahead = pair // wide + at < pair % wide
            pair, one, two = pair[ahead], one[ahead], two[ahead]
        size = (end - at) * wide
        n = np.bincount(pair, minlength=size).astype(float)
        equal = np.bincount(pair, one == two, size)
        (rx, xx), (ry, yy) = (_doubled_midranks(pair, c, size, values) for c in (one, two))
        cross = np.bincount(pair, rx * ry, size)
        met = np.flatnonzero(n)
        yield met // wide + at, met % wide, *(s[met] for s in (n, equal, cross, xx, yy))
        at = end


def _counted(ours: tuple, theirs: tuple, subjects: int, wide: int, items: int, values: int, same: bool, block: int = 256, step: int = 32, width: int = 1024) -> Iterator[tuple]:
    """``_listed`` from the number of joint ratings of each pair of values, which is a matrix product over the items; each side: subject, item, value."""
    (who, item, x), (other, their, y) = ours, theirs
    most = int(np.bincount(who).max()) * int(np.bincount(other * items + their).max())  # joint ratings of a pair, and so sums of at most four times its cube
    whole, exact = (np.float32 if bound <= 1 << 24 else np.float64 for bound in (most, 4 * most**3))
    a = np.bincount((x * subjects + who) * items + item, minlength=values * subjects * items).astype(whole).reshape(values, subjects, items)
    for right in range(0, wide, width):
        r = min(width, wide - right)
        here = (other >= right) & (other < right + r)
        b = np.bincount((their[here] * values + y[here]) * r + other[here] - right, minlength=items * values * r).astype(whole).reshape(items, values * r)
        for left in range(0, min(subjects, right + r) if same else subjects, block):
            size = min(block, subjects - left)
            sums = np.zeros((5, size, r))
            for low in range(0, size, step):
                part = a[:, left + low : left + min(size, low + step)]
                found = (part.reshape(-1, items) @ b).reshape(values, part.shape[1], values, r).astype(exact, copy=False)
                _ranked(found, sums[:, low : low + step])
            met = sums[0] > 0
            if same:
                met &= np.arange(left, left + size)[:, None] < np.arange(right, right + r)
            i, j = np.nonzero(met)
            yield i + left, j + right, *(sums.reshape(5, -1) if met.all() else sums[:, met])


def _ranked(found: np.ndarray, out: np.ndarray) -> None:
    """n, equal, cross, xx and yy from counts (own value, row, other value, column) of joint ratings."""
    values = len(found)
    own = [found[u].sum(axis=1) for u in range(values)]
    other = [sum(found[u, :, v] for u in range(1, values)) + found[0, :, v] for v in range(values)]
    ranks = []
    for counts, k in ((own, 3), (other, 4)):
        before, ranked, squares = np.zeros_like(counts[0]), [], 0
        for c in counts:
            rank = before + c
            before = rank + c
            rank += 1
            ranked.append(rank)
            squares = squares + c * rank * rank
        ranks.append(ranked)
        out[k] = squares
        out[0] = before / 2
    out[1] = sum(found[u, :, u] for u in range(values))
    cross = 0
    for u in range(values):
        cross = cross + ranks[0][u] * sum(found[u, :, v] * ranks[1][v] for v in range(values))
    out[2] = cross


def pair_agreement(ratings: DataFrame, with_rho: bool = True, tile: int = 4096, digits: int | None = None) -> DataFrame:
    """For each pair of subjects: n items both rated, share of equal ratings, rank correlation (masked, Q47).

    Subjects are dealt into tiles of about ``tile``, which meet in pairs as two tables of one row
    a subject; a task holds those and part of its result.  ``digits``: shares and correlations are rounded, half up, as they are made.
    """
    rated = stored(ratings.filter("rating IS NOT NULL AND subject IS NOT NULL").select(*COLUMNS))
    numbered = running(rated.select(*ITEM).distinct(), [*ITEM], name="_item")
    cells = F.collect_list(F.struct("_item", F.col("rating").cast("double").alias("rating")))
    rows = rated.join(numbered, [*ITEM]).groupBy("subject").agg(cells.alias("c")).select("subject", F.col("c._item").alias("items"), F.col("c.rating").alias("ratings"))
    rows = stored(rows)
    tiles = tiles_for(rows.count(), tile)
    left, right = tile_pairs(rows, "subject", tiles)

    def compare(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        for t in _agreements_of(left, right):
            for k in (3, 4):
                t = t.set_column(k, t.column_names[k], pa.array(half_up(t.column(k).to_numpy(), digits)))
            yield t

    kind = rows.schema["subject"].dataType
    found = meet(left, right, ["a", "b"], tiles * (tiles + 1) // 2, compare, f"one {kind.simpleString()}, other {kind.simpleString()}, n bigint, agreement double, rho double")
    return found.select(F.least("one", "other").alias("left"), F.greatest("one", "other").alias("right"), "n", "agreement", *(["rho"] if with_rho else []))


def rank_curve(workers: DataFrame, score: str = "rho", bad: str = "rejected", key: str = "subject") -> DataFrame:
    """Precision, recall and F of calling the k workers of least score bad, for k from 1 to n - 1 (Q23).

    Workers are ordered and summed up by ranges.
    """
    rows = workers.select(key, score, F.coalesce(F.col(bad).cast("int"), F.lit(0)).alias("_hit"))
    placed = running(running(rows, [score, key], name="_k"), [score, key], "_hit", name="_hits")
    total = rows.agg(F.sum("_hit").alias("_bad"), F.count("*").alias("_n"))
    out = placed.crossJoin(F.broadcast(total)).select(key, (F.col("_k") + 1).alias("k"), (F.col("_hits") + F.col("_hit")).alias("hits"), "_bad", "_n")
    out = out.filter(F.col("k") < F.col("_n")).withColumns({"precision": F.col("hits") / F.col("k"), "recall": F.col("hits") / F.nullif(F.col("_bad"), F.lit(0))})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f", 2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0))).drop("_bad", "_n")


def active_judgements(log: DataFrame, least: int = 10, no_answer: int = 8) -> DataFrame:
    """Judgements of workers with at least ``least`` of them (don't-knows counted), without the don't-knows."""
    own = W.partitionBy("workerId")
    return log.withColumn("_n", F.count("*").over(own)).filter((F.col("_n") >= least) & (F.col("judgement") != no_answer)).drop("_n")


def drop_inattentive(log: DataFrame, fakes: DataFrame, no_answer: int = 8) -> DataFrame:
    """Without workers who judged a made-up compound as if they knew it (Q21)."""
    failed = log.join(fakes.select("compound"), "compound", "left_semi").filter(F.col("judgement") != no_answer)
    return log.join(failed.select("workerId").distinct(), "workerId", "left_anti")


def approved(log: DataFrame, least: int = 90) -> DataFrame:
    """Workers whose approval text starts with a rate of at least ``least``."""
    return log.filter(F.split("approval", "[ %]")[0].try_cast("int") >= least)


def judgement_matrix(log: DataFrame, least: int = 10) -> DataFrame:
    """A raw judgement log as ratings of whole compounds."""
    rows = active_judgements(log, least)
    return rows.select("compound", F.lit("whole").alias("const"), F.col("workerId").alias("subject"), F.col("judgement").cast("double").alias("rating"))


def banded_results(wide: DataFrame, measures: list[str], keys: list[str]) -> DataFrame:
    """Columns m, m_std, m_low, m_high of each measure as rows (keys, variable, mean, std, low, high)."""
    each = [F.struct(F.lit(m).alias("variable"), F.col(m).alias("mean"), F.col(f"{m}_std").alias("std"), F.col(f"{m}_low").alias("low"), F.col(f"{m}_high").alias("high")) for m in measures]
    return wide.select(*keys, F.inline(F.array(*each)))


def melted(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(keys, values, "variable", "value")


@dataclass(frozen=True)
class Cleaner:
    """A named cleaning step with its parameters."""

    name: str
    clean: Callable[[DataFrame], DataFrame]
    parameters: dict = field(default_factory=dict)

    def scores(self, ratings: DataFrame, method: str = "gmean") -> DataFrame:
        return combine(aggregate(self.clean(ratings)), method)


def baseline() -> Cleaner:
    return Cleaner("baseline", lambda r: r)


def by_min_rho(rho: float) -> Cleaner:
    return Cleaner("min_rho", lambda r: drop_deviant_subjects(r, rho), {"min_rho": rho})


def by_zscore(z: float) -> Cleaner:
    return Cleaner("zscore", lambda r: drop_deviant_ratings(r, z), {"zscore": z})


def by_rebin(bins: str) -> Cleaner:
    return Cleaner("rebin", lambda r: rebin(r, bins), {"bins": bins})


def by_fill(value: float) -> Cleaner:
    return Cleaner("fill", lambda r: fill(r, value), {"fill": value})


def compare(parts: DataFrame, whole: DataFrame, methods: tuple[str, ...] = ("sum", "prod")) -> DataFrame:
    """(method, rho, n) between combined constituent means and whole-compound means."""
    wholes = aggregate(whole).select("compound", F.col("mean").alias("whole"))
    means = aggregate(parts)
    each = [combine(means, m).join(wholes, "compound").withColumn("method", F.lit(m)) for m in methods]
    return spearman(reduce(DataFrame.unionByName, each), "mean", "whole", "method")


def evaluate_cleaners(parts: DataFrame, whole: DataFrame, cleaners: list[Cleaner], method: str = "gmean") -> DataFrame:
    """(cleaner, parameters, retained, rho, n) for each cleaner; one branch of the plan for each."""
    rows = []
    for c in cleaners:
        cleaned = c.clean(parts)
        rows.append(compare(cleaned, whole, (method,)).crossJoin(retained(parts, cleaned).select("retained")).select(F.lit(c.name).alias("cleaner"), F.lit(str(c.parameters)).alias("parameters"), "retained", "rho", "n"))
    return reduce(DataFrame.unionByName, rows)
