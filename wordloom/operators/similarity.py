"""Distances and similarities of word pairs, over sparse spaces, topics and dense vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wordloom.functions.columns import divide
from wordloom.functions.tiles import half_up, meet, tile_pairs, tiles_for
from wordloom.operators.stats import midrank


def pair_set(*tables: DataFrame) -> DataFrame:
    """The union of pair tables (left, right), each pair once."""
    return reduce(DataFrame.unionByName, (t.select("left", "right") for t in tables)).distinct()


def joined_measures(*tables: DataFrame, on: tuple[str, ...] = ("left", "right")) -> DataFrame:
    """The columns of all tables for the keys that each of them has."""
    return reduce(lambda a, b: a.join(b, list(on)), tables)


def missing_words(space: DataFrame, pairs: DataFrame) -> DataFrame:
    """Words of the pairs that the space lacks."""
    words = pairs.select(F.explode(F.array("left", "right")).alias("target")).distinct()
    return words.join(space.select("target"), "target", "left_anti")


def _cells(space: DataFrame, pairs: DataFrame, how: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """Aggregate the cells of each pair of known words: per context, a and b (0 where absent)."""
    summed = space.groupBy("target", "context").agg(F.sum("value").alias("value")).filter("value <> 0")
    known = summed.select("target").distinct()
    pairs = pairs.select("left", "right").distinct()
    pairs = pairs.join(known.withColumnRenamed("target", "left"), "left", "left_semi").join(known.withColumnRenamed("target", "right"), "right", "left_semi")
    side = lambda name, a, b: pairs.join(summed.withColumnRenamed("target", name), name).select("left", "right", "context", F.expr(a).alias("a"), F.expr(b).alias("b"))
    both = side("left", "value", "0D").unionByName(side("right", "0D", "value"))
    cells = both.groupBy("left", "right", "context").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return cells.groupBy("left", "right").agg(*how(F.col("a"), F.col("b")))


def _length(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))


def _cosine(a: Column, b: Column) -> Column:
    return divide(F.sum(a * b), _length(a) * _length(b))


#: Measures that come from the sums over a pair's contexts, by name.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": _cosine,
    "dot": lambda a, b: F.sum(a * b),
    "euclid": lambda a, b: F.sqrt(F.sum((a - b) * (a - b))),
    "normeuclid": lambda a, b: F.sqrt(F.greatest(2 - 2 * _cosine(a, b), F.lit(0.0))),
    "jaccard": lambda a, b: F.count_if((a != 0) & (b != 0)) / F.nullif(F.count_if((a != 0) | (b != 0)), F.lit(0)),
}


def register(name: str) -> Callable:
    """Decorator that adds a measure: a function of two columns that returns an aggregate.  A name is given once."""

    def add(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        if name in MEASURES:
            raise ValueError(f"there is a measure {name} already")
        MEASURES[name] = f
        return f

    return add


def distances(space: DataFrame, pairs: DataFrame, *names: str) -> DataFrame:
    """(left, right, one column a measure) for the pairs of which the space knows both words.

    Repeated cells are added up (Q8); pairs without a defined value get null (Q9).
    """
    names = names or tuple(MEASURES)
    plain = [n for n in names if n != "spearman"]
    out = _cells(space, pairs, lambda a, b: [MEASURES[n](a, b).alias(n) for n in plain] or [F.count("*").alias("_n")])
    if "spearman" in names:
        out = out.join(spearman(space, pairs), ["left", "right"])
    return out.select("left", "right", *names)


def spearman(space: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rank correlation of each pair over all contexts of the space, zeros included.

    Ranks are shifted so that a zero cell has rank 0, which a correlation does
    not see; absent cells then add nothing and the space stays sparse.
    """
    cells = space.groupBy("target", "context").agg(F.sum("value").alias("value")).filter("value <> 0")
    contexts = cells.agg(F.countDistinct("context").alias("n"))
    own, sign = W.partitionBy("target"), F.signum("value")
    below = F.count_if(F.col("value") < 0).over(own)
    zeros = F.col("n") - F.count("*").over(own)
    rank = midrank("value", "target", sign)
    zero_rank = below + (zeros + 1) / F.lit(2.0)
    shifted = F.when(F.col("value") < 0, rank).otherwise(below + zeros + rank) - F.when(zeros > 0, zero_rank).otherwise(0.0)
    ranked = cells.crossJoin(F.broadcast(contexts)).select("target", "context", shifted.alias("s"), "n")
    sums = ranked.groupBy("target").agg(F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("q"), F.first("n").alias("n"))
    pairs = pairs.select("left", "right").distinct()
    left = pairs.join(ranked.select(F.col("target").alias("left"), "context", F.col("s").alias("s1")), "left")
    dots = left.join(ranked.select(F.col("target").alias("right"), "context", F.col("s").alias("s2")), ["right", "context"]).groupBy("left", "right").agg(F.sum(F.col("s1") * F.col("s2")).alias("d"))
    known = pairs.join(sums.select(F.col("target").alias("left"), F.col("s").alias("sa"), F.col("q").alias("qa"), F.col("n").cast("double").alias("n")), "left")
    known = known.join(sums.select(F.col("target").alias("right"), F.col("s").alias("sb"), F.col("q").alias("qb")), "right").join(dots, ["left", "right"], "left")
    num = F.col("n") * F.coalesce("d", F.lit(0.0)) - F.col("sa") * F.col("sb")
    den = (F.col("n") * F.col("qa") - F.col("sa") * F.col("sa")) * (F.col("n") * F.col("qb") - F.col("sb") * F.col("sb"))
    return known.select("left", "right", divide(num, F.sqrt(F.greatest(den, F.lit(0.0)))).alias("spearman"))


def _kl_term(p: Column, q: Column) -> Column:
    """p log2(p / q): 0 where p is 0, infinite where only q is (Q32)."""
    return F.when(p <= 0, F.lit(0.0)).when(q <= 0, F.lit(float("inf"))).otherwise(p * F.log2(p / q))


def divergences(topics: DataFrame, pairs: DataFrame, normalise: bool = False) -> DataFrame:
    """(left, right, kl, kl_reversed, symkl, js) between distributions (word, topic, p), in bits.

    ``normalise``: distributions are scaled to sum 1 for the two directed
    divergences and their sum, while the mean that Jensen-Shannon compares with
    is taken before scaling (Q33).
    """
    space = topics.select(F.col("word").alias("target"), F.col("topic").alias("context"), F.col("p").alias("value"))

    def measures(a: Column, b: Column) -> list[Column]:
        return [F.collect_list(F.struct(a.alias("a"), b.alias("b"))).alias("cells")]

    cells = _cells(space, pairs, measures)
    total = lambda f: F.aggregate("cells", F.lit(0.0), lambda s, x: s + f(x["a"], x["b"]))
    if normalise:
        cells = cells.withColumns({"sa": total(lambda a, b: a), "sb": total(lambda a, b: b), "sm": total(lambda a, b: (a + b) / 2)})
    else:
        cells = cells.withColumns({"sa": F.lit(1.0), "sb": F.lit(1.0), "sm": F.lit(1.0)})
    pa, pb = (lambda a: a / F.col("sa")), (lambda b: b / F.col("sb"))
    mean = lambda a, b: (a + b) / 2 / F.col("sm")
    out = cells.select(
        "left", "right",
        total(lambda a, b: _kl_term(pa(a), pb(b))).alias("kl"), total(lambda a, b: _kl_term(pb(b), pa(a))).alias("kl_reversed"),
        (total(lambda a, b: _kl_term(pa(a), mean(a, b))) / 2 + total(lambda a, b: _kl_term(pb(b), mean(a, b))) / 2).alias("js"),
    )
    return out.withColumn("symkl", F.col("kl") + F.col("kl_reversed"))


def conditional(topics: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, right_given_left, left_given_right) over topic loads (word, topic, p).

    p(w | t) is a load over its topic's sum, p(t | w) over its word's (Q29).
    """
    loads = topics.select("word", "topic", divide(F.col("p"), F.sum("p").over(W.partitionBy("topic"))).alias("w_t"), divide(F.col("p"), F.sum("p").over(W.partitionBy("word"))).alias("t_w"))
    a = loads.select(F.col("word").alias("left"), "topic", F.col("w_t").alias("lw"), F.col("t_w").alias("lt"))
    b = loads.select(F.col("word").alias("right"), "topic", F.col("w_t").alias("rw"), F.col("t_w").alias("rt"))
    joined = pairs.select("left", "right").distinct().join(a, "left").join(b, ["right", "topic"])
    return joined.groupBy("left", "right").agg(F.sum(F.col("rw") * F.col("lt")).alias("right_given_left"), F.sum(F.col("lw") * F.col("rt")).alias("left_given_right"))


_half_up = half_up


def _blocks(rows: int, wide: int, cells: int = 1 << 19) -> Iterator[slice]:
    """Slices of ``rows`` rows that have about ``cells`` cells at ``wide`` each."""
    step = max(1, cells // max(1, wide))
    return (slice(at, min(rows, at + step)) for at in range(0, rows, step))


def cosine_pairs(vectors: DataFrame, key: str, *group: str, tile: int = 8192, digits: int | None = None) -> DataFrame:
    """(a, b, cosine) of all rows of a group with a key less than another's, from ``key`` and ``vector``; null where a vector is null, zero or of another length.

    The rows of a group are dealt into tiles, which meet in pairs as two tables
    whose product goes on in parts.  The result is quadratic, what a task holds
    is not, and a row travels once for every tile of its group.
    """
    rows = vectors.select(key, *group, "vector").filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (key, *group)))
    groups, most = rows.groupBy(*group).count().agg(F.count("*"), F.max("count")).first()
    tiles = tiles_for(most or 0, tile)
    left, right = tile_pairs(rows, key, tiles)

    def matrix(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors, filled up with zeros, and their lengths; -1 where there is none."""
        lists = table.column("vector").combine_chunks()
        sizes = np.array(lists.value_lengths().fill_null(-1))
        flat = lists.flatten()
        x = np.zeros((len(table), width))
        x[np.arange(width) < sizes[:, None]] = flat.to_numpy(zero_copy_only=False)
        if flat.null_count:
            owner = np.repeat(np.arange(len(table)), np.maximum(sizes, 0))
            sizes[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
        return x, sizes

    def multiply(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        width = max(pc.max(pc.list_value_length(t.column("vector"))).as_py() or 0 for t in (left, right))
        (x, nx), (y, ny) = matrix(left, width), matrix(right, width)
        lengths = [np.sqrt((m * m).sum(1)) for m in (x, y)]
        ours, theirs = left.column(key).combine_chunks(), right.column(key).combine_chunks()
        same = left.column("a")[0].as_py() == left.column("b")[0].as_py()
        for part in _blocks(len(left), len(right)):
            with np.errstate(invalid="ignore", divide="ignore"):
                norms = lengths[0][part, None] * lengths[1]
                sims = _half_up(x[part] @ y.T / norms, digits).ravel()
            void = ((nx[part, None] != ny) | (nx[part, None] < 0) | (norms == 0)).ravel()
            n = part.stop - part.start
            a, b = ours.take(pa.array(np.repeat(np.arange(part.start, part.stop), len(right)))), pa.concat_arrays([theirs] * n)
            ahead = pc.less(a, b)
            if same:
                mask = ahead.to_numpy(zero_copy_only=False)
                yield pa.table({"a": a.filter(ahead), "b": b.filter(ahead), "cosine": pa.array(sims[mask], mask=void[mask])})
            else:
                yield pa.table({"a": pc.if_else(ahead, a, b), "b": pc.if_else(ahead, b, a), "cosine": pa.array(sims, mask=void)})

    kind = rows.schema[key].dataType.simpleString()
    return meet(left, right, [*group, "a", "b"], groups * tiles * (tiles + 1) // 2, multiply, f"a {kind}, b {kind}, cosine double")


def cosine_block(queries: DataFrame, space: DataFrame, query_tile: int = 8192, word_tile: int = 8192, digits: int | None = None) -> DataFrame:
    """(query, word, cosine) of every query with every word; both (word, vector), each word once; queries a stated set.

    Both sides are dealt into tiles of bounded size.  A pair of tiles meets in
    one group as two tables whose product goes on in parts, so each vector
    travels once for every tile of the other side.  ``digits``: cosines are rounded, half up, as they are made.
    """
    tiles = [max(1, -(-df.count() // size)) for df, size in ((queries, query_tile), (space, word_tile))]
    own = lambda df, n: df.select("word", "vector", F.pmod(F.xxhash64("word"), F.lit(n)).alias("_own"))
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    asked = own(queries, tiles[0]).select("word", "vector", F.col("_own").alias("a"), other(tiles[1]).alias("b"))
    dealt = own(space, tiles[1]).select("word", "vector", other(tiles[0]).alias("a"), F.col("_own").alias("b"))

    def matrix(table: pa.Table) -> np.ndarray:
        x = np.asarray(table.column("vector").combine_chunks().flatten(), float).reshape(len(table), -1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def multiply(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        with np.errstate(invalid="ignore", divide="ignore"):
            x, y = matrix(left), matrix(right)
        asked, words = left.column("word").combine_chunks(), right.column("word").combine_chunks()
        for part in _blocks(len(left), len(right)):
            names = asked.take(pa.array(np.repeat(np.arange(part.start, part.stop), len(right))))
            yield pa.table({"query": names, "word": pa.concat_arrays([words] * (part.stop - part.start)), "cosine": pa.array(_half_up((x[part] @ y.T).ravel(), digits))})

    return meet(asked, dealt, ["a", "b"], tiles[0] * tiles[1], multiply, "query string, word string, cosine double")
