"""Whitening of embeddings by LOBPCG (operator 13).

Vectors become whole numbers, which are stored in blocks of rows.  The
covariance is never formed: each round multiplies it by a block of directions,
as every task centres its rows, projects them on the directions, and multiplies
back; sums of tasks are added level by level.  On the driver are only blocks of
(dimensions x directions): Rayleigh-Ritz on the span of the iterate, its
residuals and the previous direction, until a product of its own certifies the
residuals.  The rows are then projected on the components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import shared_dir, written

BLOCK = "ids array<bigint>, x binary, n bigint"
#: Entries beyond this size (about a thousand million) have no exact place in the sums below.
MOST = 2.0**40
FAN_IN = 64


def _usable(vector: Column) -> Column:
    """True for vectors with entries, all of them finite numbers that scale to at most MOST."""
    fits = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= MOST / 1024)
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fits), F.lit(False))


def blocks_of(df: DataFrame, id_col: str, vector_col: str, rows: int = 4096) -> DataFrame:
    """(ids, x, n): the usable vectors as matrices of floor(1024 * entry) + 100000, at most ``rows`` in one."""
    doubles = F.col(f"`{vector_col}`").cast("array<double>")
    plain = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), doubles.alias("vector")).filter(_usable(F.col("vector")))

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), rows):
                part = b.slice(at, rows)
                vectors = part.column("vector")
                size = np.diff(np.asarray(vectors.offsets))
                flat = np.floor(1024 * np.asarray(vectors.flatten())).astype(np.int64) + 100_000
                ids = part.column("id")
                for d in np.unique(size):  # as a rule one
                    own = np.flatnonzero(size == d)
                    x = flat[np.repeat(size == d, size)]
                    yield pa.RecordBatch.from_arrays([pa.array([ids.take(pa.array(own)).to_pylist()], pa.list_(pa.int64())), pa.array([x.astype("<i8").tobytes()], pa.binary()), pa.array([len(own)], pa.int64())], ["ids", "x", "n"])

    return plain.mapInArrow(stack, BLOCK)


def summed(df: DataFrame, measure: Callable[[np.ndarray], np.ndarray], kind: type = float) -> np.ndarray:
    """The sum of ``measure`` (an array of one shape, of doubles or of ``kind``) over all blocks.

    Tasks are added in groups of FAN_IN, and these again, so that neither a
    task nor the driver ever holds more than FAN_IN arrays.
    """

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            for x, n in zip(b.column("x").to_pylist(), b.column("n").to_pylist(), strict=True):
                part = measure(np.frombuffer(x, "<i8").reshape(n, -1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["place", "value"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        total = sum(np.frombuffer(v, kind) for v in table.column("value").to_pylist())
        return pa.table({"place": pa.array([table.column("place")[0].as_py() // FAN_IN], pa.int64()), "value": pa.array([total.tobytes()], pa.binary())})

    parts = df.select("x", "n").mapInArrow(of_task, "place bigint, value binary")
    left = df.rdd.getNumPartitions()
    while left > FAN_IN:
        parts = parts.groupBy(F.floor(F.col("place") / FAN_IN)).applyInArrow(add, "place bigint, value binary")
        left = math.ceil(left / FAN_IN)
    return sum(np.frombuffer(r["value"], kind) for r in sorted(parts.collect(), key=lambda r: r["place"]))


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """x - mean, where the mean is ``whole`` + ``rest`` / n: the subtraction of whole numbers is exact."""
    return (x - whole) - rest / n


def lobpcg(product: Callable[[np.ndarray], np.ndarray], size: int, count: int, guard: int = 12, tolerance: float = 1e-13, most_rounds: int = 300, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors (columns) of a symmetric matrix.

    ``product`` multiplies the matrix by a block of columns.  The iterate has
    ``guard`` columns more than are asked for, which speeds up close values.
    Each round takes one product with an orthonormal basis of the iterate, its
    residuals and the previous direction.  Once the residuals of all ``count``
    pairs are at most ``tolerance`` times the largest eigenvalue, or rounding
    lets them fall no further, a product of the vectors themselves must certify
    residuals of 1e-11 or less.
    """
    width = min(size, count + guard)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    least, stalled = np.inf, 0
    for _ in range(most_rounds):
        image = product(basis)
        gram = basis.T @ image
        values, mix = np.linalg.eigh((gram + gram.T) / 2)
        values, mix = values[::-1][:width], mix[:, ::-1][:, :width]
        iterate = basis @ mix
        residual = image @ mix - iterate * values
        scale = max(abs(values[0]), np.finfo(float).tiny)
        worst = np.linalg.norm(residual[:, :count], axis=0).max() / scale
        stalled = stalled + 1 if worst <= 1e-11 and worst > least / 2 else 0
        least = min(least, worst)
        if worst <= tolerance or stalled > 3:
            vectors = np.linalg.qr(iterate[:, :count])[0]
            moved = product(vectors)
            sure = (vectors * moved).sum(axis=0)
            if np.linalg.norm(moved - vectors * sure, axis=0).max() <= 1e-11 * scale:
                order = np.argsort(-sure, kind="stable")
                return sure[order], vectors[:, order]
        previous = basis @ np.vstack([np.zeros((width, width)), mix[width:]]) if basis.shape[1] > width else np.zeros((size, 0))
        wide = np.hstack([iterate, residual, previous])
        wide = wide / np.maximum(np.linalg.norm(wide, axis=0), np.finfo(float).tiny)
        q, r = np.linalg.qr(wide)
        basis = np.linalg.qr(q[:, np.abs(np.diag(r)) > 1e-10])[0]
    raise ArithmeticError(f"residuals of {least:.1e} of the largest eigenvalue after {most_rounds} rounds")


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Rows whose vector is null, empty, or holds null or non-finite entries (or
    entries of 2**30 or more, which have no exact sums) take no part; nor do those of
    another length than the commonest one (of equally common ones the longest).
    Null and repeated ids are rows like any other; other columns are of no
    matter.  Components of no variance (less than 1e-9 of the largest) have no
    whitened values and are left out, so one row alone, or equal rows, give no
    rows, as an empty table does.  A deviation beyond 64 bits is null.  Signs:
    the largest entry of a component is positive.
    """
    spark = df.sparkSession
    out = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    blocks = written(blocks_of(df, id_col, vector_col), f"{shared_dir(spark)}/blocks")
    sizes = blocks.groupBy((F.length("x") / F.col("n") / 8).cast("int").alias("d")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], out)
    d, n = sizes["d"], sizes["n"]
    blocks = blocks.filter(F.length("x") == F.col("n") * 8 * d)

    # exact sums as low and high parts, which fit 64 bits for 2**41 rows
    halves = summed(blocks, lambda x: np.concatenate([(x & 0x3FFFFF).sum(axis=0), (x >> 22).sum(axis=0)]), np.int64)
    sums = [int(high) * 2**22 + int(low) for low, high in zip(halves[:d], halves[d:], strict=True)]
    whole, rest = np.array([s // n for s in sums]), np.array([s % n for s in sums])

    trace = float(summed(blocks, lambda x: np.square(_centred(x, whole, rest, n)).sum(keepdims=True).ravel())[0]) / n
    if not trace > 0:
        return spark.createDataFrame([], out)

    def product(directions: np.ndarray) -> np.ndarray:
        def of_block(x: np.ndarray) -> np.ndarray:
            rows = _centred(x, whole, rest, n)
            return (rows.T @ (rows @ directions)).ravel()

        return summed(blocks, of_block).reshape(directions.shape) / n

    values, vectors = lobpcg(product, d, min(components, d))
    varied = values > 1e-9 * values[0]
    values, vectors = values[varied], vectors[:, varied]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    weights = vectors / np.sqrt(values)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = _centred(x, whole, rest, n) @ weights
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = summed(blocks, moments) / n
    error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, raw, rows in zip(b.column("ids"), b.column("x").to_pylist(), b.column("n").to_pylist(), strict=True):
                x = np.frombuffer(raw, "<i8").reshape(rows, d) - whole
                near = float(np.abs(x).max() + 1) * n
                if near * near * d < 2.0**62:
                    deviation = np.square(n * x - rest).sum(axis=1).tolist()
                else:  # beyond 64 bits on the way
                    deviation = [v if v < 2**63 else None for v in (sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in x.tolist())]
                w = (x - rest / n) @ weights
                at = np.repeat(np.arange(rows), k)
                fixed = lambda v, kind: pa.array(np.full(rows * k, v), kind)
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), fixed(n, pa.int64()), pa.array(deviation, pa.int64()).take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(explained, rows)), fixed(error, pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return blocks.mapInArrow(project, out)
