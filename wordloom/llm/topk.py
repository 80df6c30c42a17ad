"""Exact top-k search by tiled matrix products (operator 10).

Queries and rows are dealt into tiles by hash.  Every pair of a query tile and
a row tile is one small matrix product whose best entries are selected in
place; the per-tile lists are then merged in a tree, so no task meets more
than one pair of tiles or a fixed number of lists.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LISTS = "query_id bigint, part bigint, vec_id bigint, score {kind}"


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold finite numbers only."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    rows = column.combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) and rows.num_chunks else rows
    values = np.asarray(rows.flatten(), kind)
    return values.reshape(len(rows), -1) if len(rows) else values.reshape(0, 0)


def select(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, sizes: np.ndarray, rows: np.ndarray, k: int,
    approximate: Callable[[np.ndarray, np.ndarray], np.ndarray], exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, slack: float = 0.0, block: int = 512,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query id, id, score) of each query row in one tile.

    Row r of ``rows`` stands for the next ``sizes[r]`` entries of ``ids``, all
    with the same vector.  ``approximate`` scores all pairs; those within
    ``slack`` of a query's last place are scored again by ``exact``, row by row.
    Ties go to the smaller id, and a query's own id is left out.
    """
    out: list[tuple] = []
    first = np.cumsum(sizes) - sizes
    # so many rows hold k + 1 different ids, however often one of them repeats
    enough = (k + 1) * int(np.unique(ids, return_counts=True)[1].max(initial=1))
    for low in range(0, len(queries), block):
        q, own = queries[low : low + block], query_ids[low : low + block]
        score = approximate(q, rows)
        most = min(enough, len(rows))
        last = np.partition(score, len(rows) - most, axis=1)[:, len(rows) - most]
        r, c = np.nonzero(score >= last[:, None] - slack)
        s = exact(q[r], rows[c]) if exact else score[r, c]
        n = sizes[c]
        at = np.repeat(first[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        r, s, i = np.repeat(r, n), np.repeat(s, n), ids[at]
        keep = i != own[r]
        r, s, i = r[keep], s[keep], i[keep]
        # the best row of each id, then the best k of each query
        order = np.lexsort((-s, i, r))
        r, s, i = r[order], s[order], i[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
        r, s, i = r[new], s[new], i[new]
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        keep = rank < k
        out.append((own[r[keep]], i[keep], s[keep]))
    joined = [np.concatenate(x) for x in zip(*out, strict=True)]
    return tuple(joined) if joined else (np.zeros(0, np.int64),) * 3


def merge_lists(lists: DataFrame, k: int, parts: int, fan: int = 64) -> DataFrame:
    """Merge lists (query_id, part, vec_id, score) into the k best of each query, with ranks from 1.

    ``parts``: the number of different values of ``part``, from 0.  The lists
    of at most ``fan`` parts of a query meet in one group of a level.
    """
    while True:
        parts = -(-parts // fan)
        lists = lists.groupBy("query_id", F.floor(F.col("part") / fan).alias("part"), "vec_id").agg(F.max("score").alias("score"))
        best = W.partitionBy("query_id", "part").orderBy(F.col("score").desc(), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        if parts <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")


def inner_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: as doubles where those are exact, else as 64-bit integers or Python's."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return queries @ rows.T
    exact = queries.astype(object) @ rows.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int, query_tile: int = 4096, row_tile: int = 2048) -> DataFrame:
    """The k rows of largest inner product for each query: query_id, rank, vec_id, score.

    ``queries``: query_id bigint, vector array<bigint>; ``rows``: vec_id bigint,
    vector array<bigint>.  A query's own id is left out; ties go to the smaller
    vec_id.  Rows without an id, null vectors and vectors with null components
    take no part; only vectors of one length meet.  Several vectors under one id
    count as one candidate with its best score.  Scores beyond 64 bits become
    the nearest 64-bit integer.  Empty tables give no rows.
    """
    whole = lambda c: F.col(c).isNotNull() & F.coalesce(F.forall(F.col(c), lambda x: x.isNotNull()), F.lit(False))
    queries = queries.select("query_id", "vector").filter(F.col("query_id").isNotNull() & whole("vector")).distinct()
    rows = rows.select("vec_id", "vector").filter(F.col("vec_id").isNotNull() & whole("vector")).distinct()
    query_tiles, row_tiles = (max(1, -(-x.count() // size)) for x, size in ((queries, query_tile), (rows, row_tile)))
    tile = lambda name, n: F.pmod(F.xxhash64(name, "vector"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = queries.select("query_id", "vector", F.size("vector").alias("size"), tile("query_id", query_tiles).alias("q_tile"), every(row_tiles).alias("d_tile"))
    right = rows.select("vec_id", F.col("vector").alias("row"), F.size("vector").alias("size"), tile("vec_id", row_tiles).alias("d_tile"), every(query_tiles).alias("q_tile"))

    def best(key: tuple, q: pa.Table, d: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if q.num_rows and d.num_rows:
            ids = d.column("vec_id").to_numpy()
            found = select(q.column("query_id").to_numpy(), matrix(q.column("vector"), np.int64), ids, np.ones(len(ids), np.int64), matrix(d.column("row"), np.int64), k, inner_products)
        part = np.full(len(found[0]), key[2].as_py(), np.int64)
        return pa.table([pa.array(x, pa.int64()) for x in (found[0], part, found[1], found[2])], names=["query_id", "part", "vec_id", "score"])

    names = ["size", "q_tile", "d_tile"]
    lists = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(best, LISTS.format(kind="bigint"))
    return merge_lists(lists, k, row_tiles)
