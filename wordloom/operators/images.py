"""Bags of visual words, roll-ups of vectors, and experiments over several dense spaces."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.columns import cosine, divide, dot, norm_of, uniform, unit
from wordloom.operators.stats import spearman, spearman_p


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest_centre(descriptors: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Descriptors (..., values) with ``cluster``, the nearest centre's number from 0, ties to the lower one.

    The centres are a codebook of fixed size and part of the plan.
    """
    table = F.array(*(F.struct(squared_distance(F.col("values"), F.array(*map(F.lit, c))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)))
    return descriptors.withColumn("cluster", F.array_min(table)["k"])


def visual_words(descriptors: DataFrame, clusters: int, cells: int = 4) -> DataFrame:
    """(image, bin, n) from (image, x, y, cluster), x and y in [0, 1): one codebook for each cell of a grid."""
    place = lambda c: F.least(F.floor(F.col(c) * cells), F.lit(cells - 1))
    number = clusters * (place("x") * cells + place("y")) + F.col("cluster")
    return descriptors.groupBy("image", number.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def hyponym_members(mapping: DataFrame, hyponyms: DataFrame) -> DataFrame:
    """(compound, synset): mapping (compound, synsets, blank-separated) through hyponyms (orig, synset)."""
    each = mapping.filter("synsets IS NOT NULL").select("compound", F.explode(F.split("synsets", " ")).alias("orig"))
    return each.join(hyponyms, "orig").select("compound", "synset")


def sum_vectors(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, vector): element-wise sums (raw ones, Q36)."""
    cells = rows.select(key, F.posexplode(vector).alias("at", "x")).groupBy(key, "at").agg(F.sum("x").alias("x"))
    return cells.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("vector"))


def crop(left: Column, top: Column, width: Column, height: Column, share: float = 1.0) -> Column:
    """A box scaled about its middle."""
    grow = lambda start, size: start + size * (1 - share) / 2
    return F.struct(grow(left, width).alias("left"), grow(top, height).alias("top"), (width * share).alias("width"), (height * share).alias("height"))


def subsets(names: list[str]) -> list[tuple[str, ...]]:
    """All non-empty subsets."""
    return [s for n in range(1, len(names) + 1) for s in itertools.combinations(names, n)]


def joined_space(spaces: DataFrame, names: tuple[str, ...], power: int = 1) -> DataFrame:
    """(word, vector): the vectors of (space, word, vector) that a word has in all the named spaces, normalised and joined."""
    rows = spaces.filter(F.col("space").isin(*names)).select("space", "word", unit(F.col("vector"), power).alias("v"))
    both = rows.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("space", "v"))).alias("parts")).filter(F.size("parts") == len(names))
    return both.select("word", F.flatten(F.transform("parts", lambda p: p["v"])).alias("vector"))


#: Measures of two dense vectors.
DENSE = {
    "cosine": cosine,
    "dot": dot,
    "euclid": lambda a, b: F.sqrt(squared_distance(a, b)),
    "length_ratio": lambda a, b: divide(norm_of(a), norm_of(b)),
}


def score_pairs(space: DataFrame, gold: DataFrame, measure: str = "cosine") -> DataFrame:
    """(compound, const, mean, score) for gold pairs whose words the space (word, vector) has."""
    a = space.select(F.col("word").alias("compound"), F.col("vector").alias("_a"))
    b = space.select(F.col("word").alias("const"), F.col("vector").alias("_b"))
    pairs = gold.filter("compound <> const").join(a, "compound").join(b, "const")
    return pairs.select("compound", "const", "mean", DENSE[measure](F.col("_a"), F.col("_b")).alias("score"))


def subset_experiment(spaces: DataFrame, gold: DataFrame, names: list[str], measure: str = "cosine") -> DataFrame:
    """(spaces, rho, n, p) for every subset, over the gold pairs that all spaces can score (Q34)."""
    shared = spaces.groupBy("word").agg(F.countDistinct("space").alias("n")).filter(F.col("n") == len(names)).select("word")
    usable = spaces.join(shared, "word", "left_semi")
    rows = [score_pairs(joined_space(usable, s), gold, measure).withColumn("spaces", F.lit("+".join(s))) for s in subsets(names)]
    return spearman(reduce(DataFrame.unionByName, rows), "mean", "score", "spaces").withColumn("p", spearman_p("rho", "n"))


def sampled_members(members: DataFrame, classes: DataFrame, share: float = 1.0, seed: int = 42) -> DataFrame:
    """Members (class, name, ...) of the listed classes (class), each kept with probability ``share`` by a hash of its name."""
    return members.join(classes.select("class").distinct(), "class", "left_semi").filter(uniform(seed, "class", "name") < share)


def bands(values: np.ndarray, count: int = 4) -> list[tuple[int, list[float]]]:
    """Sum, least and largest value of each of ``count`` equal stretches."""
    return [(k, [float(part.sum()), float(part.min()), float(part.max())]) for k, part in enumerate(np.array_split(values, count)) if len(part)]


def peaks(values: np.ndarray) -> list[tuple[int, list[float]]]:
    """Each value above both of its neighbours, by its place."""
    inner = np.flatnonzero((values[1:-1] > values[:-2]) & (values[1:-1] > values[2:])) + 1
    return [(int(k), [float(values[k])]) for k in inner]


def tally(values: np.ndarray, low: float = -1.0, high: float = 1.0, bins: int = 8) -> list[tuple[int, list[float]]]:
    """One histogram over equal bins; what lies outside counts for the nearest."""
    place = np.clip(np.floor((values - low) / (high - low) * bins), 0, bins - 1).astype(int)
    return [(0, np.bincount(place, minlength=bins).astype(float).tolist())]


#: Descriptor functions by name: each makes rows (place, values) of one array of numbers.
FEATURE_FUNCTIONS: dict[str, Callable[[np.ndarray], list[tuple[int, list[float]]]]] = {"bands": bands, "peaks": peaks, "tally": tally}


@F.udtf(returnType="feature string, place int, values array<double>")
class Describe:
    """Table function: the rows that the functions named in ``names`` (joined by commas) make of an array; none for a null or empty one."""

    def eval(self, values: list, names: str):
        x = np.array([v for v in values or [] if v is not None], float)
        for name in filter(None, (names or "").split(",")):
            if name not in FEATURE_FUNCTIONS:
                raise ValueError(f"no feature function {name!r}")
            for place, found in FEATURE_FUNCTIONS[name](x) if len(x) else []:
                yield name, place, found


def described(rows: DataFrame, column: str, *names: str) -> DataFrame:
    """``rows`` with (feature, place, values): one row for each that a function makes of the array, called laterally."""
    return rows.lateralJoin(Describe(F.col(column).outer(), F.lit(",".join(names))))


def register_describe(spark: SparkSession, name: str = "describe_features") -> None:
    """Make ``Describe`` callable from SQL: ``FROM t, LATERAL describe_features(t.v, 'bands,peaks')``."""
    spark.udtf.register(name, Describe)
