"""Ratings from pairwise matches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wordloom.functions.columns import uniform
from wordloom.operators import ratings as R
from wordloom.operators.ranks import running

START, STEP, SPREAD = 1500.0, 0.03, 400.0


def numbered_items(ratings: DataFrame) -> DataFrame:
    """(compound, const, item): items numbered from 0 in their order, as in matches."""
    return running(ratings.select(*R.ITEM).distinct(), list(R.ITEM), name="item")


def result_table(result: DataFrame, ratings: DataFrame) -> DataFrame:
    """(compound, const, and the columns of ``result``): ratings of numbered items with the items' own names; those that met nobody have nulls."""
    return numbered_items(ratings).join(result, "item", "left").drop("item")


def random_matches(spark: SparkSession, ratings: DataFrame, trials: int, seed: int = 42) -> DataFrame:
    """(trial, a, b, score): a random subject's ratings of two random items; 1, 0.5 or 0 for the first.

    Draws of an item that the subject did not rate use up their trial (Q48).
    Subjects and items are numbered, and draws meet them by number.
    """
    number = lambda df, name: running(df, df.columns, name=name)
    items = numbered_items(ratings)
    subjects = number(ratings.select("subject").distinct(), "person")
    n_items, n_subjects = items.count(), subjects.count()
    known = ratings.join(items, [*R.ITEM]).join(subjects, "subject").select("person", "item", "rating")
    pick = lambda tag, n: F.floor(uniform(f"{seed}{tag}", "trial") * n)
    draws = spark.range(1, trials + 1).select(F.col("id").alias("trial")).withColumns({"person": pick("s", n_subjects), "a": pick("a", n_items), "b": pick("b", n_items)}).filter("a <> b")
    first = known.select("person", F.col("item").alias("a"), F.col("rating").alias("x"))
    second = known.select("person", F.col("item").alias("b"), F.col("rating").alias("y"))
    met = draws.join(first, ["person", "a"]).join(second, ["person", "b"])
    return met.select("trial", "a", "b", ((F.signum(F.col("x") - F.col("y")) + 1) / 2).alias("score"))


def play(state: dict, a: int, b: int, score: float, step: float = STEP, start: float = START, spread: float = SPREAD) -> None:
    """One match: both ratings move by ``step`` times how far the score is from the expected one."""
    ra, rb = state.get(a, start), state.get(b, start)
    expected = 1.0 / (1.0 + 10.0 ** ((rb - ra) / spread))
    state[a], state[b] = ra + step * (score - expected), rb - step * (score - expected)


def elo(matches: DataFrame, group: list[tuple[str, str]] | None = None, step: float = STEP, start: float = START, spread: float = SPREAD) -> DataFrame:
    """(item, rating, n) after all matches (trial, a, b, score) in order of trial.

    The result depends on the order, so the matches of a group are folded one
    after another: Spark sorts them, and a task takes them in Arrow batches with
    a state of two numbers for each item.  ``group`` (pairs of a column and its
    type) deals out independent runs.
    """
    names = [n for n, _ in group or []]
    schema = "".join(f"{n} {t}, " for n, t in group or []) + "item bigint, rating double, n bigint"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, state, seen = None, {}, {}

        def result() -> pa.RecordBatch:
            keys = {n: [run[k]] * len(state) for k, n in enumerate(names)}
            return pa.RecordBatch.from_pydict({**keys, "item": list(state), "rating": list(state.values()), "n": [seen[i] for i in state]}, kinds)

        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in names), strict=True) if names else [()] * len(batch)
            for key, a, b, s in zip(keys, *(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("a", "b", "score")), strict=True):
                if key != run:
                    if state:
                        yield result()
                    run, state, seen = key, {}, {}
                play(state, a, b, s, step, start, spread)
                seen[a], seen[b] = seen.get(a, 0) + 1, seen.get(b, 0) + 1
        if state:
            yield result()

    dealt = matches.repartition(*names) if names else matches.repartition(1)
    return dealt.sortWithinPartitions(*names, "trial").select(*names, "a", "b", "score").mapInArrow(fold, schema)
