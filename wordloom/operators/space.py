"""Sparse word spaces: rows (target, context, value), absent rows are zero."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.columns import divide, safe_log2, word_of
from wordloom.functions.scratch import stored
from wordloom.operators.ranks import running


def with_masses(space: DataFrame) -> DataFrame:
    """The space with the masses of each row's target and context, and of the whole.

    Whatever the space is made from is read once: its cells are written, and one
    aggregate of them gives all masses.  The total is a table of one row.
    """
    space = stored(space.select("target", "context", "value"))
    sums = stored(masses(space))
    by = lambda name: sums.filter(F.col("kind") == name).select(F.col("key").alias(name), F.col("mass").alias(f"{name}_mass"))
    total = sums.filter("kind = 'total'").select(F.col("mass").alias("total_mass"))
    return space.join(by("target"), "target").join(by("context"), "context").crossJoin(F.broadcast(total))


def masses(space: DataFrame) -> DataFrame:
    """All masses as rows (kind, key, mass): total, by target, by context; one aggregate of grouping sets."""
    sets = space.groupingSets([[F.col("target")], [F.col("context")], []], F.col("target"), F.col("context"))
    sums = sets.agg(F.sum("value").alias("mass"), F.grouping("target").alias("_t"), F.grouping("context").alias("_c"))
    kind = F.when(F.col("_t") == 0, "target").when(F.col("_c") == 0, "context").otherwise("total")
    key = F.when(F.col("_t") == 0, F.col("target")).when(F.col("_c") == 0, F.col("context")).otherwise("")
    return sums.select(kind.alias("kind"), key.alias("key"), "mass")


def _weighted(space: DataFrame, value) -> DataFrame:
    return with_masses(space).select("target", "context", value.alias("value"))


def pmi(space: DataFrame) -> DataFrame:
    """Pointwise mutual information in bits; null where a mass has no logarithm."""
    return _weighted(space, _pmi())


def _pmi():
    return safe_log2(F.col("value")) + safe_log2(F.col("total_mass")) - safe_log2(F.col("target_mass")) - safe_log2(F.col("context_mass"))


def lmi(space: DataFrame) -> DataFrame:
    """Local mutual information: the cell's probability times its pointwise one."""
    return _weighted(space, divide(F.col("value"), F.col("total_mass")) * _pmi())


def clipped_lmi(space: DataFrame) -> DataFrame:
    """Local mutual information with what is negative or undefined set to 0."""
    return lmi(space).withColumn("value", F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))


def prob(space: DataFrame) -> DataFrame:
    total = space.agg(F.sum("value").alias("total_mass"))
    return space.crossJoin(F.broadcast(total)).select("target", "context", divide(F.col("value"), F.col("total_mass")).alias("value"))


def neglogprob(space: DataFrame) -> DataFrame:
    total = space.agg(F.sum("value").alias("total_mass"))
    return space.crossJoin(F.broadcast(total)).select("target", "context", (safe_log2(F.col("total_mass")) - safe_log2(F.col("value"))).alias("value"))


def norm1(space: DataFrame) -> DataFrame:
    """Each value over its target's mass."""
    return normalise_by(space, "target")


def norm2(space: DataFrame) -> DataFrame:
    """Each value over its target's Euclidean length."""
    return _over(space, "target", F.sqrt(F.sum(F.col("value") * F.col("value"))))


def positive(space: DataFrame) -> DataFrame:
    return space.filter("value > 0")


def identity(space: DataFrame) -> DataFrame:
    return space


def tfidf(space: DataFrame) -> DataFrame:
    raise NotImplementedError("tfidf has no definition here")


WEIGHTINGS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "pmi": pmi, "lmi": lmi, "prob": prob, "neglogprob": neglogprob, "norm1": norm1, "norm2": norm2,
    "positive": positive, "nop": identity, "tfidf": tfidf, "clipped_lmi": clipped_lmi,
}


def weight(space: DataFrame, *methods: str | Callable[[DataFrame], DataFrame], stopwords: DataFrame | None = None, keep: int | None = None, keep_by: str = "mass") -> DataFrame:
    """Remove stopword contexts, keep the top contexts, then apply the methods in order.

    Masses are worked out anew before each method, on what the ones before left
    (Q4).  A method is a name of WEIGHTINGS or a function of a space.
    """
    if stopwords is not None:
        space = remove_contexts(space, stopwords)
    if keep is not None:
        space = keep_contexts(space, top_contexts(space, keep, keep_by))
    return reduce(lambda s, m: s.transform(WEIGHTINGS[m] if isinstance(m, str) else m), methods, space)


def top_contexts(space: DataFrame, count: int, by: str = "mass") -> DataFrame:
    """The ``count`` heaviest contexts, ties by name; or the last ones by name (Q1)."""
    if by == "name":
        return space.select("context").distinct().orderBy(F.col("context").desc()).limit(count)
    sums = space.groupBy("context").agg(F.sum("value").alias("mass"))
    return sums.orderBy(F.col("mass").desc(), "context").limit(count).select("context")


def keep_contexts(space: DataFrame, contexts: DataFrame) -> DataFrame:
    return space.join(contexts, "context", "left_semi").select("target", "context", "value")


def remove_contexts(space: DataFrame, contexts: DataFrame) -> DataFrame:
    return space.join(contexts, "context", "left_anti").select("target", "context", "value")


def keep_targets(space: DataFrame, words: DataFrame, without_pos: bool = False) -> DataFrame:
    """Rows whose target (its word part, if ``without_pos``) is in ``words`` (word)."""
    key = word_of(F.col("target")) if without_pos else F.col("target")
    return space.withColumn("word", key).join(words.select("word").distinct(), "word", "left_semi").select("target", "context", "value")


def without_pos(space: DataFrame) -> DataFrame:
    """The space with targets stripped of their part of speech and equal cells added up."""
    return space.groupBy(word_of(F.col("target")).alias("target"), "context").agg(F.sum("value").alias("value"))


def frequent_contexts(space: DataFrame, least: int = 2) -> DataFrame:
    """Contexts with at least ``least`` rows, counted before cells are merged (Q6): (context, n)."""
    return space.groupBy("context").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def context_numbers(space: DataFrame, least: int = 2) -> DataFrame:
    """Frequent contexts and their column numbers, from 0 in order of name, numbered by ranges."""
    return running(frequent_contexts(space, least).select("context"), ["context"], name="number")


def dense_rows(space: DataFrame, least: int = 2, truncate: bool = False) -> DataFrame:
    """(word, vector): a value for each frequent context in order of name, 0 where absent.

    ``truncate`` drops fractions (Q5).  A vector has as many entries as there
    are contexts, so this is for spaces of few contexts.
    """
    names = frequent_contexts(space, least).agg(F.sort_array(F.collect_list("context")).alias("names"))
    cells = without_pos(space.join(frequent_contexts(space, least), "context", "left_semi"))
    value = F.when(F.isnan("value"), F.col("value")).otherwise(F.col("value").cast("bigint").cast("double")) if truncate else F.col("value")
    rows = cells.groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("context", value))).alias("cells"))
    filled = F.transform("names", lambda n: F.coalesce(F.element_at("cells", n), F.lit(0.0)))
    return rows.crossJoin(F.broadcast(names)).select(F.col("target").alias("word"), filled.alias("vector"))


def stack(**spaces: DataFrame) -> DataFrame:
    """All spaces as one, each context prefixed by its space's name and a colon."""
    parts = [s.select("target", F.concat_ws(":", F.lit(name), "context").alias("context"), "value") for name, s in spaces.items()]
    return reduce(DataFrame.unionByName, parts)


def normalise_by(space: DataFrame, key: str) -> DataFrame:
    """Values over the sum of their ``key`` (target or context)."""
    return _over(space, key, F.sum("value"))


def _over(space: DataFrame, key: str, amount: Column) -> DataFrame:
    """Values over an aggregate of their key: summed before the shuffle and joined back, so that a hot key is no task of its own."""
    space = stored(space.select("target", "context", "value"))
    sums = space.groupBy(key).agg(amount.alias("_amount"))
    return space.join(sums, key).select("target", "context", divide(F.col("value"), F.col("_amount")).alias("value"))
