"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 5).

Each table projects unit vectors on Gaussian directions and cuts the line in
steps; a bucket is a tuple of steps.  A query visits its own bucket and
perturbed ones in order of estimated success (the summed squared distances to
the borders that a perturbation crosses).  Every row of the visited buckets is
scored exactly, and the tables' candidates are merged.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wordloom.llm.topk import LISTS, matrix, merge_lists, select, usable


#: Groups of tiles whose lists are merged first.
PARTS = 64 * 64


class Hashing:
    """p-stable hash functions for vectors of ``size`` components, the same in every process."""

    def __init__(self, size: int, tables: int, projections: int, width: float, seed: int):
        rng = np.random.default_rng([seed, size])
        self.directions = rng.standard_normal((tables, size, projections))
        self.shift = rng.random((tables, projections)) * width
        self.mix = rng.integers(1, 2**63 - 1, (tables, projections), dtype=np.int64) | 1
        self.width = width
        self.moves = np.array(list(itertools.product((0, -1, 1), repeat=projections)), np.int64)  # of which a query makes the likeliest

    def _places(self, units: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        at = (units @ self.directions[table] + self.shift[table]) / self.width
        step = np.floor(at)
        return step.astype(np.int64), at - step

    def _key(self, steps: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (steps * self.mix[table]).sum(axis=-1)

    def buckets(self, units: np.ndarray, table: int) -> np.ndarray:
        return self._key(self._places(units, table)[0], table)

    def probes(self, units: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` buckets of a table that each vector visits first, likeliest first."""
        step, rest = self._places(units, table)
        cost = (rest**2) @ (self.moves == -1).T + ((1 - rest) ** 2) @ (self.moves == 1).T
        order = np.argsort(cost, axis=1, kind="stable")[:, :count]
        return self._key(step[:, None, :] + self.moves[order], table)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row cosine in double precision."""
    a, b = shrunk(a), shrunk(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def shrunk(x: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two, which rounds nothing, so that their squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def units(x: np.ndarray) -> np.ndarray:
    x = shrunk(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(df: DataFrame, vec_id: Column, vector: Column) -> DataFrame:
    rows = df.select(vec_id.cast("bigint").alias("vec_id"), vector.cast("array<double>").alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)).distinct()


def nearest(
    queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = 3, projections: int = 6, width: float = 2.0, probes: int = 100, tile: int = 4096, seed: int = 20,
) -> DataFrame:
    """The k nearest found by cosine for each query: query_id, rank, vec_id, score.

    A query's own id is left out, ties go to the smaller vec_id, and scores are
    exact.  Rows without an id and vectors that are null, zero or hold null or
    non-finite components take no part; only vectors of one length meet.  Rows
    with the same vector are indexed once, with their k + 1 smallest ids, as no
    others can be among the first k.  Several vectors under one id count with
    the best score.  Buckets of any size are searched whole, in tiles.  Empty
    tables give no rows.

    Vectors are hashed at unit length, so ``width`` needs no scale.  The
    defaults reach a recall of 0.9 where neighbours stand out little, at the
    price of many candidates; more ``projections`` make buckets smaller where
    they stand out more.
    """
    vector = lambda df: _vectors(df, F.col(f"`{id_col}`"), F.col(f"`{vector_col}`"))
    same = W.partitionBy("vector").orderBy("vec_id")
    classes = vector(rows).withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = vector(queries).select(F.col("vec_id").alias("query_id"), "vector")

    def hashed(count: int):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[int, Hashing] = {}
            for b in batches:
                lengths = np.asarray(b.column("vector").value_lengths())
                for size in np.unique(lengths).tolist():
                    part = b.filter(pa.array(lengths == size))
                    hashing = made.setdefault(size, Hashing(size, tables, projections, width, seed))
                    x = units(matrix(pa.chunked_array([part.column("vector")])))
                    for t in range(tables):
                        keys = hashing.probes(x, t, count) if count else hashing.buckets(x, t)[:, None]
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t] * len(x), pa.int32()), lists], [*part.schema.names, "table", "buckets"])

        return deal

    index = classes.mapInArrow(hashed(0), "vector array<double>, ids array<bigint>, table int, buckets array<bigint>").select("vector", "ids", F.size("vector").alias("size"), "table", F.explode("buckets").alias("bucket"))
    visits = asked.mapInArrow(hashed(probes), "query_id bigint, vector array<double>, table int, buckets array<bigint>").select("query_id", "vector", F.size("vector").alias("size"), "table", F.explode("buckets").alias("bucket"))

    place = ["size", "table", "bucket"]
    tiles = lambda n: F.ceil(F.col(n) / tile).cast("bigint")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), tiles(n) - 1))
    row_counts = index.groupBy(*place).agg(F.count("*").alias("n_rows"))
    query_counts = visits.groupBy(*place).agg(F.count("*").alias("n_queries")).hint("merge")
    # merged: what repeats is so small when shuffled that Spark would take it for a table to broadcast by way of the driver
    sizes = row_counts.join(query_counts, place).hint("merge")
    left = visits.join(sizes, place).select("query_id", "vector", *place, F.pmod(F.xxhash64("query_id"), tiles("n_queries")).alias("q_tile"), every("n_rows").alias("d_tile"))
    right = index.join(sizes, place).select("ids", F.col("vector").alias("row"), *place, F.pmod(F.xxhash64("ids"), tiles("n_rows")).alias("d_tile"), every("n_queries").alias("q_tile"))

    def best(key: tuple, q: pa.Table, d: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        if q.num_rows and d.num_rows:
            ids = d.column("ids").combine_chunks()
            members, counts = np.asarray(ids.flatten(), np.int64), np.asarray(ids.value_lengths(), np.int64)
            x, y = matrix(q.column("vector")), matrix(d.column("row"))
            found = select(q.column("query_id").to_numpy(), x, members, counts, y, k, lambda a, b: units(a) @ units(b).T, cosines, 1e-9)
        part = np.full(len(found[0]), key[4].as_py() % PARTS, np.int64)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(part), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "part", "vec_id", "score"])

    names = [*place, "q_tile", "d_tile"]
    lists = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(best, LISTS.format(kind="double"))
    return merge_lists(lists, k, PARTS)
