"""Ranks, percentiles and counts of ordered pairs over whole tables, without a task that sees all rows.

Rows are first counted by distinct value.  Those are dealt into ranges of the
order, each range is summed up by its own task, and the sums of the ranges
(one number each) are added up before it.  So a running sum is a local one and
an offset.  Where the ranges fall depends on samples, so the dealt rows are
written once and read again.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wordloom.functions.columns import divide
from wordloom.functions.scratch import stored


def running(df: DataFrame, order: list[str], amount: str | None = None, name: str = "before") -> DataFrame:
    """``df`` and ``name``: the sum of ``amount`` (rows, if none) over all rows that come before in ``order``.

    ``order`` should tell all rows apart; equal ones come in any order.
    """
    spark = df.sparkSession
    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    one = F.lit(1) if amount is None else F.col(amount)
    sums = sorted((r["_range"], r["s"]) for r in dealt.groupBy("_range").agg(F.sum(one).alias("s")).collect())  # one row for each range
    starts = accumulate((s or 0 for _, s in sums), initial=0)
    offsets = spark.createDataFrame([(k, int(at)) for (k, _), at in zip(sums, starts, strict=False)], "_range int, _offset bigint")
    earlier = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = F.coalesce(F.sum(one).over(earlier), F.lit(0)).cast("bigint")
    return dealt.withColumn("_within", within).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_within") + F.col("_offset")).drop("_range", "_within", "_offset")


def counted(df: DataFrame, value: str, *group: str, name: str = "before", size: str = "n") -> DataFrame:
    """(group..., value, ``size``, ``name``): distinct values, how often each occurs, and how many smaller ones its group has."""
    counts = stored(running(df.groupBy(*group, value).agg(F.count("*").alias(size)), [*group, value], size, "_at"))
    if not group:
        return counts.withColumnRenamed("_at", name)
    start = counts.groupBy(*group).agg(F.min("_at").alias("_start"))
    return counts.join(start, [*group]).withColumn(name, F.col("_at") - F.col("_start")).drop("_at", "_start")


def midranks(df: DataFrame, value: str, *group: str, name: str = "rank") -> DataFrame:
    """``df`` and ``name``: the rank within the group, ties sharing the mean of their ranks; rows without a value leave."""
    ranks = counted(df.filter(F.col(value).isNotNull()), value, *group, name="_before", size="_n")
    return df.join(ranks.select(*group, value, (F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)).alias(name)), [*group, value])


def rank_correlation(df: DataFrame, x: str, y: str, *group: str, undefined: float | None = -1.0) -> DataFrame:
    """(group..., rho, n) over the rows with both values, for groups of any size; an undefined rho becomes ``undefined``.

    Equal pairs of values are one row with a count, so little is joined where
    values repeat.
    """
    cells = stored(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_n")))

    def ranks(value: str, name: str) -> DataFrame:
        sums = stored(running(cells.groupBy(*group, value).agg(F.sum("_n").alias("_k")), [*group, value], "_k", "_at"))
        if group:
            sums = sums.join(sums.groupBy(*group).agg(F.min("_at").alias("_start")), [*group])
        start = F.col("_start") if group else F.lit(0)
        return sums.select(*group, value, (F.col("_at") - start + (F.col("_k") + 1) / F.lit(2.0)).alias(name))

    both = cells.join(ranks("_x", "_rx"), [*group, "_x"]).join(ranks("_y", "_ry"), [*group, "_y"])
    sums = {"n": F.lit(1.0), "sx": F.col("_rx"), "sy": F.col("_ry"), "xx": F.col("_rx") * F.col("_rx"), "yy": F.col("_ry") * F.col("_ry"), "xy": F.col("_rx") * F.col("_ry")}
    total = both.groupBy(*group).agg(*(F.sum(F.col("_n") * v).alias(f"_{k}") for k, v in sums.items()))
    c = lambda k: F.col(f"_{k}")
    spread = (c("n") * c("xx") - c("sx") * c("sx")) * (c("n") * c("yy") - c("sy") * c("sy"))
    rho = divide(c("n") * c("xy") - c("sx") * c("sy"), F.sqrt(F.greatest(spread, F.lit(0.0))))
    rho = rho if undefined is None else F.coalesce(rho, F.lit(undefined))
    return total.select(*group, rho.alias("rho"), F.coalesce(c("n"), F.lit(0)).cast("bigint").alias("n"))


def percentiles(df: DataFrame, value: str, count: str, *group: str, shares: tuple[float, ...]) -> DataFrame:
    """(group..., p5, ...): interpolated percentiles of values that occur ``count`` times each, as of all of them in a row."""
    held = df.filter(F.col(value).isNotNull() & (F.col(count) > 0)).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.sum(F.col(count).cast("bigint")).alias("_k"))
    at = stored(running(held, [*group, "_v"], "_k", "_at"))
    ends = at.groupBy(*group).agg(F.min("_at").alias("_start"), F.sum("_k").alias("_all"))
    placed = at.join(ends, [*group]) if group else at.crossJoin(F.broadcast(ends))
    first = F.col("_at") - F.col("_start")

    def found(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place < first + F.col("_k")), F.col("_v")))

    columns = []
    for s in shares:
        exact = F.lit(float(s)) * (F.col("_all") - 1)
        columns += [found(F.floor(exact)), found(F.ceil(exact)), F.max(exact - F.floor(exact))]
    out = placed.groupBy(*group).agg(*(c.alias(f"_c{k}") for k, c in enumerate(columns)))
    mixed = lambda k: F.col(f"_c{3 * k}") * (1 - F.col(f"_c{3 * k + 2}")) + F.col(f"_c{3 * k + 1}") * F.col(f"_c{3 * k + 2}")
    return out.select(*group, *(mixed(k).alias(f"p{round(100 * s)}") for k, s in enumerate(shares)))


def below(values: np.ndarray, first: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each pair (a, b): how many of the first a values are less than b.  All are whole numbers from 0.

    A wavelet matrix: bit by bit from the highest one, values are parted by
    the bit, and the ends of each prefix follow them.
    """
    low, high, out = np.zeros(len(first), np.int64), first.astype(np.int64), np.zeros(len(first), np.int64)
    most = max(int(values.max(initial=0)), int(bound.max(initial=0)))
    for bit in range(most.bit_length() - 1, -1, -1):
        one = (values >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        set_ = (bound >> bit & 1).astype(bool)
        a, b = zeros[low], zeros[high]
        out += np.where(set_, b - a, 0)
        low, high = np.where(set_, zeros[-1] + low - a, a), np.where(set_, zeros[-1] + high - b, b)
        values = np.concatenate([values[~one], values[one]])
    return out


def dominated(points: DataFrame, queries: DataFrame, size: int | None = None) -> DataFrame:
    """``queries`` (a, b, and more columns) and ``under``: how many points (px, py) have px < a and py < b.

    px and py number the points from 0 in two orders.  Both are cut into blocks
    of ``size``: the points in blocks before the query's on both sides come from
    a table of two-dimensional prefix counts; those in its block of px, and those
    in its block of py further left, are counted by the task of that block.
    The table has at most a million entries.
    """
    points, total = points.select(F.col("px").cast("bigint"), F.col("py").cast("bigint")), points.count()
    size = size or max(1 << 14, -(-total // 1000))
    blocks = total // size + 1
    of = lambda c: F.floor(F.col(c) / size)
    grid = points.groupBy((of("px") + 1).alias("_i"), (of("py") + 1).alias("_j")).agg(F.count("*").alias("_n"))
    cells = points.sparkSession.range((blocks + 1) ** 2).select(F.floor(F.col("id") / (blocks + 1)).alias("_i"), (F.col("id") % (blocks + 1)).alias("_j"))
    along = cells.join(grid, ["_i", "_j"], "left").withColumn("_s", F.sum(F.coalesce("_n", F.lit(0))).over(W.partitionBy("_i").orderBy("_j")))
    prefix = along.select("_i", "_j", F.sum("_s").over(W.partitionBy("_j").orderBy("_i")).alias("_whole"))

    asked = stored(queries.select("a", "b").distinct())
    held = asked.withColumns({"_i": of("a"), "_j": of("b")})

    def strip(points_at: str, queries_at: str, reach: Column) -> DataFrame:
        """(a, b, under): the points of the query's block with px < ``reach`` and py < b; queries of one block are dealt into parts."""
        parts = held.groupBy(queries_at).agg(F.ceil(F.count("*") / F.lit(1 << 16)).cast("bigint").alias("_parts"))
        rows = held.join(parts, queries_at).select(F.col(queries_at).alias("_block"), F.pmod(F.xxhash64("a", "b"), F.col("_parts")).alias("_part"), "a", "b", reach.alias("_reach"))
        dealt = points.withColumn(queries_at, of(points_at)).join(parts, queries_at).select(F.col(queries_at).alias("_block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part"), "px", "py")

        def count(left: pa.Table, right: pa.Table) -> pa.Table:
            px, py = np.asarray(left.column("px")), np.asarray(left.column("py"))
            order = np.argsort(px)
            px, py = px[order], py[order]
            ranked = np.sort(py)
            reached = np.searchsorted(px, np.asarray(right.column("_reach")))
            found = below(np.searchsorted(ranked, py), reached, np.searchsorted(ranked, np.asarray(right.column("b"))))
            return pa.table({"a": right.column("a"), "b": right.column("b"), "under": pa.array(found, pa.int64())})

        return dealt.groupBy("_block", "_part").cogroup(rows.groupBy("_block", "_part")).applyInArrow(count, "a bigint, b bigint, under bigint")

    whole = held.join(prefix, ["_i", "_j"]).select("a", "b", F.col("_whole").cast("bigint").alias("under"))
    parts = [whole, strip("px", "_i", F.col("a")), strip("py", "_j", F.col("_i") * size)]
    sums = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("a", "b").agg(F.sum("under").alias("under"))
    return queries.join(sums, ["a", "b"])


def ordered_alike(rows: DataFrame, gap: float, *group: str, size: int | None = None) -> DataFrame:
    """(group..., pairs, hits, first_less) over the pairs of rows whose ``gold`` is at least ``gap`` apart.

    ``rows``: (group..., key, gold, value), each key once in a group.  A pair,
    the smaller key first, is a hit if its gold rises exactly where its value
    rises, and counts in ``first_less`` if its gold rises.  Golds and their
    differences are compared at nine decimals.
    """
    group = group or ("_all",)
    rows = (rows if "_all" not in group else rows.withColumn("_all", F.lit(0))).filter("gold IS NOT NULL AND value IS NOT NULL")
    rows = rows.select(*group, "key", F.round("gold", 9).alias("gold"), "value")
    by_gold = stored(running(rows, [*group, "gold", "value", "key"], name="px"))
    by_value = stored(running(by_gold, [*group, "value", "key"], name="py"))
    every = stored(running(by_value, [*group, "key"], name="pk"))

    # how many rows come before what is at least ``gap`` less: bounds that no row has count for nothing
    bound = F.round(F.col("gold") - gap, 9)
    bounds = rows.select(*group, F.col("gold").alias("at"), F.lit(1).alias("n")).unionByName(rows.select(*group, bound.alias("at"), F.lit(0).alias("n")))
    reach = running(bounds.groupBy(*group, "at").agg(F.sum("n").alias("n")), [*group, "at"], "n").select(*group, F.col("at").alias("_bound"), (F.col("before") + F.col("n")).alias("a"))
    start = every.groupBy(*group).agg(F.min("px").alias("_start"))
    same = every.groupBy(*group, "value").agg(F.min("py").alias("_first"), F.count("*").alias("_size"))
    asked = every.withColumn("_bound", bound).join(reach, [*group, "_bound"]).join(same, [*group, "value"]).join(start, [*group])
    asked = stored(asked.filter(F.col("a") > F.col("_start")))

    # lesser values are hits; of equal ones those of a later key
    sides = F.inline(F.array(*(F.struct(b.alias("b"), F.lit(w).alias("w")) for b, w in ((F.col("_first"), 1), (F.col("_first") + F.col("_size"), 1), (F.col("py"), -1)))))
    less = asked.select(*group, "_start", "a", sides).groupBy(*group, "_start", "a", "b").agg(F.sum("w").alias("w")).filter("w <> 0")
    hits = dominated(every, less, size).groupBy(*group).agg(F.sum(F.col("w") * (F.col("under") - F.col("_start"))).alias("hits"))
    keys = dominated(every.select("px", F.col("pk").alias("py")), asked.select(*group, "_start", "a", F.col("pk").alias("b")), size)
    rises = keys.groupBy(*group).agg(F.sum(F.col("under") - F.col("_start")).alias("first_less"))
    pairs = asked.groupBy(*group).agg(F.sum(F.col("a") - F.col("_start")).alias("pairs"))
    out = pairs.join(hits, [*group]).join(rises, [*group])
    return out.select(*(g for g in group if g != "_all"), "pairs", "hits", "first_less")
