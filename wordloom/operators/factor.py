"""Low-rank factors of rating matrices and word spaces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.columns import uniform
from wordloom.functions.scratch import remove, scratch_dir, stored
from wordloom.functions.tiles import every_pair
from wordloom.operators import ratings as R
from wordloom.operators.ranks import running

#: Names of a side of a space whose Gram matrix may be summed up as one: at most 2 MB.
NARROW = 512


def complete_rank(matrix: np.ndarray, rank: int, epochs: int = 10_000, rate: float = 0.001, tolerance: float = 1e-5, start: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """``complete_cells`` of the cells of a matrix that are not NaN."""
    i, j = np.nonzero(~np.isnan(matrix))
    return complete_cells(i, j, matrix[i, j], matrix.shape, rank, epochs, rate, tolerance, start)


def complete_cells(i: np.ndarray, j: np.ndarray, value: np.ndarray, shape: tuple[int, int], rank: int, epochs: int = 10_000, rate: float = 0.001, tolerance: float = 1e-5, start: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Factors u (rows x rank) and v (rank x columns), fitted one rank after another by full-batch descent.

    The matrix is given by the rows, columns and values of its known cells,
    each once.  A rank stops when its mean squared error, missing cells counted as 0,
    changes by less than ``tolerance``.  Memory grows with the known cells.
    """
    u, v = np.zeros((shape[0], rank)), np.zeros((rank, shape[1]))
    rest, size = value.astype(float), shape[0] * shape[1]
    for k in range(rank):
        a, b = np.full(shape[0], start), np.full(shape[1], start)
        last = np.inf
        for _ in range(epochs):
            left, right = a[i], b[j]
            error = rest - left * right
            loss = float(error @ error) / size
            if abs(last - loss) < tolerance:
                break
            last = loss
            right *= error
            left *= error
            a, b = a + rate * np.bincount(i, right, shape[0]), b + rate * np.bincount(j, left, shape[1])
        u[:, k], v[k] = a, b
        rest -= a[i] * b[j]
    return u, v


FACTORS = "{keys}k int, side string, compound string, const string, subject string, value double"


def completion_factors(ratings: DataFrame, rank: int, group: list[tuple[str, str]] | None = None, epochs: int = 10_000, rate: float = 0.001) -> DataFrame:
    """Nested factors (k, side: item or subject, keys, value) of each group's rating matrix.

    A study's matrix (items by subjects) is one group; trials and data sets are
    dealt out by ``group``, pairs of a column and its type.
    """
    names = [n for n, _ in group or []]

    fields = [f"{n} {t}" for n, t in group or []]
    item = F.struct(*(F.col(c).cast("string").alias(c) for c in R.ITEM))
    typed = ratings.select(*names, item.alias("item"), F.col("subject").cast("string").alias("subject"), F.col("rating").cast("double").alias("rating"))
    typed = stored(typed.filter(" AND ".join(f"{c} IS NOT NULL" for c in ("item.compound", "item.const", "subject"))))
    # rows and columns by number, so that no text comes into the task of a group: the place in the order of all, which is not gapless within a group
    base = scratch_dir(ratings.sparkSession)
    numbers = {c: stored(running(typed.select(c).distinct(), [c], name="n").withColumnRenamed(c, "key"), f"{base}/{c}") for c in ("item", "subject")}
    cells = typed
    for c, short in (("item", "i"), ("subject", "j")):
        cells = cells.join(numbers[c].select(F.col("key").alias(c), F.col("n").alias(short)), c).drop(c)
    cells = cells.filter("rating IS NOT NULL AND NOT isnan(rating)").groupBy(*names, "i", "j").agg(F.first("rating").alias("rating"))

    def factors(table: pa.Table) -> pa.Table:
        order = np.lexsort([np.asarray(table.column("j")), np.asarray(table.column("i"))])
        (items, i), (subjects, j) = (np.unique(np.asarray(table.column(c))[order], return_inverse=True) for c in "ij")
        u, v = complete_cells(i, j, np.asarray(table.column("rating"))[order], (len(items), len(subjects)), rank, epochs, rate)
        many = (len(items) + len(subjects)) * rank
        out = {n: pa.array([table.column(n)[0].as_py()] * many, table.schema.field(n).type) for n in names}
        out["k"] = pa.array(np.concatenate([np.repeat(np.arange(1, rank + 1), len(x)) for x in (items, subjects)]), pa.int32())
        out["of_item"] = pa.array([True] * (rank * len(items)) + [False] * (rank * len(subjects)))
        out["n"] = pa.array(np.concatenate([np.tile(items, rank), np.tile(subjects, rank)]), pa.int64())
        return pa.table(out | {"value": pa.array(np.concatenate([u.T.reshape(-1), v.reshape(-1)]))})

    keyed = cells.groupBy(*names) if names else cells.groupBy()
    found = stored(keyed.applyInArrow(factors, ", ".join([*fields, "k int, of_item boolean, n bigint, value double"])))
    none, key = F.lit(None).cast("string"), F.col("key")
    items = found.filter("of_item").join(numbers["item"], "n").select(*names, "k", F.lit("item").alias("side"), key["compound"].alias("compound"), key["const"].alias("const"), none.alias("subject"), "value")
    return items.unionByName(found.filter("NOT of_item").join(numbers["subject"], "n").select(*names, "k", F.lit("subject").alias("side"), none.alias("compound"), none.alias("const"), key.alias("subject"), "value"))


def _vectors(factors: DataFrame, name: str, *key: str) -> DataFrame:
    """(key, name): the values of each key in order of k."""
    return factors.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias(name))


def _dot(left: str, right: str) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a["value"] * b["value"]), F.lit(0.0), lambda s, x: s + x)


def completed(factors: DataFrame, rank: int, *group: str) -> DataFrame:
    """Ratings of every item by every subject from the first ``rank`` factors."""
    own = factors.filter(F.col("k") <= rank)
    items = _vectors(own.filter("side = 'item'"), "_u", *group, *R.ITEM)
    subjects = stored(_vectors(own.filter("side = 'subject'"), "_v", *group, "subject"))
    return every_pair(items, subjects, *group).select(*group, *R.ITEM, "subject", _dot("_u", "_v").alias("rating"))


def by_svd(rank: int, epochs: int = 10_000) -> R.Cleaner:
    """A cleaner that replaces all ratings by their low-rank estimates."""
    def clean(r: DataFrame) -> DataFrame:
        run = R.run_of(r)
        return completed(completion_factors(r, rank, [(c, r.schema[c].dataType.simpleString()) for c in run], epochs), rank, *run)

    return R.Cleaner("svd", clean, {"svd_k": rank})


def zero_filled_svd(ratings: DataFrame, rank: int) -> DataFrame:
    """Rank-``rank`` reconstruction of the rating matrix with blanks as 0, for every cell; names become text."""
    item = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in R.ITEM))).alias("target")
    subject, value = F.col("subject").cast("string").alias("context"), F.first("rating").alias("value")
    one_to_one = all(ratings.schema[c].dataType.typeName() in ("string", "byte", "short", "integer", "long") for c in (*R.ITEM, "subject"))
    if one_to_one:  # no two names have one text, so they need not be dealt out by it
        cells = ratings.groupBy(*R.ITEM, "subject").agg(value).select(item, subject, "value")
    else:
        cells = ratings.groupBy(item, subject).agg(value)
    targets, sigmas, contexts = space_svd(cells, rank, extra=rank + 32, unique=True)
    left, right = _factor_vectors(targets, sigmas, contexts)
    names = left.select(F.from_json("target", "compound string, const string").alias("i"), "_target").select("i.compound", "i.const", "_target")
    return every_pair(names, stored(right)).select(*R.ITEM, F.col("context").alias("subject"), _dot("_target", "_context").alias("rating"))


def _dense(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield np.asarray(batch.column("values").flatten()).reshape(len(batch), -1)


def _filled(batch: pa.RecordBatch, width: int, rows: int = 2048) -> Iterator[np.ndarray]:
    """The rows of ``places`` and ``values`` with zeros elsewhere, some at a time."""
    for at in range(0, len(batch), rows):
        part = batch.slice(at, rows)
        places, x = part.column("places"), np.zeros((len(part), width))
        x[np.repeat(np.arange(len(part)), places.value_lengths().to_numpy()), places.flatten().to_numpy()] = part.column("values").flatten().to_numpy()
        yield x


def _grams(rows: DataFrame, blocks: Callable[[pa.RecordBatch], Iterator[np.ndarray]] = _dense, fan_in: int = 64) -> np.ndarray:
    """The sum of the outer products of the rows: tasks add up their own, and groups of tasks those, until ``fan_in`` sums are left."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            for x in blocks(b) if len(b) else ():
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["place", "sum"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v) for v in table.sort_by("place").column("sum").to_pylist())
        return pa.table({"place": pa.array([table.column("place")[0].as_py() // fan_in], pa.int64()), "sum": pa.array([total.tobytes()], pa.binary())})

    parts, left = rows.mapInArrow(of_task, "place bigint, sum binary"), rows.rdd.getNumPartitions()
    while left > fan_in:
        parts = parts.groupBy(F.floor(F.col("place") / fan_in)).applyInArrow(add, "place bigint, sum binary")
        left = -(-left // fan_in)
    total = sum(np.frombuffer(r["sum"]) for r in sorted(parts.collect(), key=lambda r: r["place"]))
    width = int(round(np.size(total) ** 0.5))
    return np.reshape(total, (width, width))


def _times(rows: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """(key, values) with each row of values multiplied by a small matrix."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("values").flatten()).reshape(len(b), -1) @ matrix if len(b) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(x.tolist(), pa.list_(pa.float64()))], [key, "values"])

    return rows.select(key, "values").mapInArrow(multiply, f"{key} string, values array<double>")


def _product(cells: DataFrame, rows: DataFrame, by: str, to: str, width: int) -> DataFrame:
    """(to, values): the sparse cells times rows (by, values); sums of tasks are added up by ``to``."""
    met = cells.join(rows, by)
    return met.groupBy(to).agg(F.array(*(F.sum(F.col("value") * F.get("values", k)) for k in range(width))).alias("values"))


def _narrow_svd(cells: DataFrame, names: list[str], narrow: str, wide: str, rank: int, min_sigma: float | None, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors of the narrow side, sigmas, vectors of the wide side) of cells whose narrow side has few names.

    The cells of a wide name are one row, and all rows are summed up to the
    Gram matrix of the narrow side, which the driver solves.  A second pass
    multiplies the rows by its vectors: lengths of the products are the
    singular values, small ones too.  Cells without a name take no part.
    """
    spark, width = cells.sparkSession, len(names)
    numbers = F.broadcast(spark.createDataFrame(list(zip(names, range(width), strict=True)), f"{narrow} string, n int"))
    lists = F.collect_list(F.struct("n", "value"))
    rows = cells.filter(F.col(wide).isNotNull()).join(numbers, narrow).groupBy(wide).agg(lists.alias("c")).select(wide, F.col("c.n").alias("places"), F.col("c.value").alias("values"))
    rows = stored(rows, f"{base}/rows")
    squares, vectors = np.linalg.eigh(_grams(rows.select("places", "values"), lambda b: _filled(b, width), max(2, min(64, (4 << 20) // (width * width)))))
    vectors = vectors[:, np.argsort(-squares, kind="stable")[:rank]]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([part @ vectors for part in _filled(b, width)]) if len(b) else np.zeros((0, vectors.shape[1]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(wide), lists], [wide, "values"])

    products = stored(rows.mapInArrow(multiply, f"{wide} string, values array<double>"), f"{base}/products")
    sigmas = np.sqrt(np.diag(_grams(products.select("values"))))
    order = np.argsort(-sigmas, kind="stable")
    keep = [k for k in order if sigmas[k] > 1e-7 * sigmas[order[0]] and (min_sigma is None or sigmas[k] >= min_sigma)]
    table = spark.createDataFrame([(i + 1, float(sigmas[k])) for i, k in enumerate(keep)], "k int, sigma double")
    own = spark.createDataFrame([(name, i + 1, float(vectors[n, k])) for n, name in enumerate(names) for i, k in enumerate(keep)], f"{narrow} string, k int, value double")
    other = products.select(wide, F.posexplode(F.array(*(F.get("values", int(k)) / float(sigmas[k]) for k in keep))).alias("k", "value")).select(wide, (F.col("k") + 1).alias("k"), "value")
    return own, table, other


def space_svd(space: DataFrame, rank: int, min_sigma: float | None = None, extra: int = 8, rounds: int = 60, tolerance: float = 1e-9, seed: int = 42, unique: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Truncated SVD of a sparse space: (targets, sigmas, contexts) in long form.

    Repeated cells are added up; with ``unique`` there are none.

    Targets: (target, k, value) with left vectors, contexts likewise with right
    ones, sigmas: (k, sigma), without those below ``min_sigma`` or a ten-millionth of the first.

    Block subspace iteration: a table of ``rank + extra`` numbers for each
    context is multiplied by the cells and by their transpose, as joins and
    sums, and made orthonormal by its small Gram matrix, until the singular
    values change by less than ``tolerance`` of the first.  The driver holds
    matrices of rank by rank only.  Where there are at most ``NARROW`` targets
    or contexts, two passes over the cells do (``_narrow_svd``).
    """
    spark = space.sparkSession
    base, width = scratch_dir(spark), rank + extra
    summed = space.select("target", "context", F.col("value").cast("double").alias("value")) if unique else space.groupBy("target", "context").agg(F.sum("value").cast("double").alias("value"))
    cells = stored(summed.filter("value <> 0"), f"{base}/cells")
    for narrow, wide in (("target", "context"), ("context", "target")):
        names = [r[0] for r in cells.select(narrow).distinct().limit(NARROW + 1).collect()]
        if 0 < len(names) <= NARROW:
            found = _narrow_svd(cells, sorted(x for x in names if x is not None), narrow, wide, rank, min_sigma, base)
            return found if narrow == "target" else found[::-1]
    start = cells.select("context").distinct().withColumn("values", F.array(*(uniform(f"{seed}-{k}", "context") - 0.5 for k in range(width))))

    def orthonormal(rows: DataFrame, path: str) -> DataFrame:
        for turn in (1, 2):
            values, vectors = np.linalg.eigh(_grams(rows))
            kept = values > 1e-14 * max(values.max(initial=0.0), np.finfo(float).tiny)
            rows = stored(_times(rows, "context", vectors[:, kept] / np.sqrt(values[kept])), f"{path}-{turn}")
            if values[kept].max() < 1e4 * values[kept].min():
                break  # else once more, for what rounding has left
        return rows

    if cells.isEmpty():
        none = [spark.createDataFrame([], f"{n} string, k int, value double") for n in ("target", "context")]
        return none[0], spark.createDataFrame([], "k int, sigma double"), none[1]
    right = orthonormal(stored(start, f"{base}/start"), f"{base}/right-0")
    last = np.zeros(0)
    for turn in range(1, rounds + 1):
        size = len(right.first()["values"])
        left = stored(_product(cells, right, "context", "target", size), f"{base}/left-{turn}")
        squares, mix = np.linalg.eigh(_grams(left))
        sigmas, mix = np.sqrt(np.maximum(squares[::-1], 0)), mix[:, ::-1]
        if len(last) == len(sigmas) and np.abs(sigmas - last)[:rank].max() <= tolerance * sigmas[0]:
            break
        last = sigmas[: int((squares > 1e-14 * squares.max()).sum())]
        if turn < rounds:
            good = squares[::-1] > 1e-14 * squares.max()
            turned = mix[:, good] / squares[::-1][good]
            back = stored(_product(cells, _times(left, "target", turned), "target", "context", int(good.sum())), f"{base}/back-{turn}")
            right = orthonormal(back, f"{base}/right-{turn}")
            for old in (f"left-{turn}", f"back-{turn}", f"right-{turn - 1}-1", f"right-{turn - 1}-2"):
                remove(spark, f"{base}/{old}")
    keep = [k for k in range(min(rank, len(sigmas))) if sigmas[k] > 1e-7 * sigmas[0] and (min_sigma is None or sigmas[k] >= min_sigma)]
    spread = lambda rows, key, m: _times(rows, key, m[:, keep]).select(key, F.posexplode("values").alias("k", "value")).select(key, (F.col("k") + 1).alias("k"), "value")
    table = spark.createDataFrame([(i + 1, float(sigmas[k])) for i, k in enumerate(keep)], "k int, sigma double")
    return spread(left, "target", mix / np.maximum(sigmas, 1e-300)), table, spread(right, "context", mix)


def latent(targets: DataFrame, sigmas: DataFrame) -> DataFrame:
    """Coordinates of the targets: left vectors times singular values."""
    return targets.join(F.broadcast(sigmas), "k").select("target", "k", (F.col("value") * F.col("sigma")).alias("value"))


def _factor_vectors(targets: DataFrame, sigmas: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target, _target) and (context, _context), whose products are the cells."""
    return _vectors(latent(targets, sigmas), "_target", "target"), _vectors(contexts.join(F.broadcast(sigmas), "k"), "_context", "context")


def reduce_space(targets: DataFrame, sigmas: DataFrame, contexts: DataFrame, min_sigma: float | None = None, max_dim: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(target, context, value): the space put together again from its factors, without small singular values or later dimensions.

    Every target has a value for every context; ``wanted`` (target, context)
    asks for some cells only.
    """
    kept = sigmas.filter(F.lit(True) if min_sigma is None else F.col("sigma") >= min_sigma).filter(F.lit(True) if max_dim is None else F.col("k") <= max_dim)
    left, right = _factor_vectors(targets, kept, contexts)
    if wanted is not None:
        met = wanted.select("target", "context").join(left, "target").join(right, "context")
    else:
        met = every_pair(left, stored(right))
    return met.select("target", "context", _dot("_target", "_context").alias("value"))
