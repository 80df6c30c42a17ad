"""Streaming forms: running co-occurrence counts, and match ratings that follow a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wordloom.operators.matches import play


def running_cells(cells: DataFrame, time: str | None = None, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(target, context, value): running sums of a stream of cells, by window of event time if ``time`` is given."""
    keys = ["target", "context"]
    if time is not None:
        cells = cells.withWatermark(time, delay)
        keys = [F.window(time, window).alias("window"), *keys]
    return cells.groupBy(*keys).agg(F.sum("value").alias("value"))


def running_elo(matches: DataFrame, group: str) -> DataFrame:
    """(group, item, rating) after each batch of a stream of matches (group, trial, a, b, score).

    The state of a group is one number for each of its items.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ratings = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("trial", kind="stable")
        for a, b, s in rows[["a", "b", "score"]].itertuples(index=False):
            play(ratings, a, b, s)
        state.update((list(ratings), list(ratings.values())))
        yield pd.DataFrame({group: key[0], "item": list(ratings), "rating": list(ratings.values())})

    kind = matches.schema[group].dataType.simpleString()
    return matches.groupBy(group).applyInPandasWithState(fold, f"{group} {kind}, item bigint, rating double", "items array<bigint>, ratings array<double>", "update", GroupStateTimeout.NoTimeout)
