"""Text quality from pooled random-indexing word vectors (operator 9).

Every word bucket has a sparse ternary index vector.  A bucket's word vector is
the sum of the index vectors of its neighbours over all documents, scaled to
length one.  A document is pooled to the mean of its word vectors and the mean
of the products of adjacent ones, which a two-layer numpy network classifies;
its probabilities are calibrated by a temperature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.pretokens import slices
from wordloom.llm.shared import held_out
from wordloom.llm.toxicity import scored, sigmoid
from wordloom.llm.words import tokens

BUCKETS, SIZE, WINDOW, CHUNK = 1 << 14, 32, 2, 256


def index_vectors(seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Two places and two signs of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, SIZE, (BUCKETS, 2)), rng.choice([-1.0, 1.0], (BUCKETS, 2))


def neighbour_sums(texts: list[bytes], places: np.ndarray, signs: np.ndarray, sums: np.ndarray, block: int = 1_000_000) -> None:
    """Add the index vectors of all words up to WINDOW places beside each word to ``sums``."""
    found, counts = tokens(texts, BUCKETS)
    text = np.repeat(np.arange(len(texts)), counts)
    for low in range(0, len(found), block):
        w, t = found[low : low + block + WINDOW], text[low : low + block + WINDOW]
        for step in range(1, WINDOW + 1):
            a, b = w[:-step][:block], w[step:][:block]
            same = t[:-step][:block] == t[step:][:block]
            a, b = a[same].astype(np.int64) * SIZE, b[same].astype(np.int64) * SIZE
            for j in range(2):
                sums += np.bincount(np.concatenate([a + places[b // SIZE, j], b + places[a // SIZE, j]]), np.concatenate([signs[b // SIZE, j], signs[a // SIZE, j]]), len(sums))


def word_vectors(df: DataFrame, text_col: str = "text", slice_bytes: int = 4_000_000) -> np.ndarray:
    """Unit word vectors by bucket from all texts, BUCKETS x SIZE.

    Each task sums its own texts, in whole numbers, so that scores do not depend
    on how texts are dealt out; 64 groups of sums are added first, then those.
    The result has a fixed size (2 MB).  Words without neighbours have a zero vector.
    """
    rows = df.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).filter("text IS NOT NULL")
    schema = "chunk int, part int, sums binary"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        places, signs = index_vectors()
        sums, some = np.zeros(BUCKETS * SIZE), False
        for b in batches:
            for group in slices(((t,) for t in b.column("text").to_pylist()), slice_bytes):
                neighbour_sums([t for t, in group], places, signs, sums)
                some = True
        if some:
            parts = sums.reshape(BUCKETS // CHUNK, -1)
            full = np.flatnonzero(parts.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([TaskContext.get().partitionId()] * len(full), pa.int32()), pa.array([parts[c].astype("<i8").tobytes() for c in full], pa.binary())], ["chunk", "part", "sums"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in table.column("sums").to_pylist())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["chunk", "part", "sums"])

    sums = rows.mapInArrow(local, schema)
    sums = sums.withColumn("part", F.pmod("part", F.lit(64))).groupBy("chunk", "part").applyInArrow(add, schema)
    out = np.zeros((BUCKETS // CHUNK, CHUNK * SIZE))
    for r in sums.groupBy("chunk").applyInArrow(add, schema).collect():  # BUCKETS / CHUNK rows
        out[r["chunk"]] = np.frombuffer(r["sums"], "<i8")
    out = out.reshape(BUCKETS, SIZE)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(length > 0, length, 1)).astype(np.float32)


def pool(texts: list[bytes], vectors: np.ndarray, block: int = 100_000) -> np.ndarray:
    """For each text: the mean word vector, the mean product of adjacent ones, and a log of its length."""
    found, counts = tokens(texts, BUCKETS)
    text = np.repeat(np.arange(len(texts)), counts)
    sums = np.zeros((len(texts), 2 * SIZE), np.float64)
    for low in range(0, len(found), block):
        w, t = found[low : low + block + 1], text[low : low + block + 1]
        v = vectors[w]
        pair = np.zeros_like(v[:block])
        pair[: len(v) - 1] = v[:-1] * v[1:] * (t[:-1] == t[1:])[:, None]
        own = t[:block]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sums[own[first]] += np.add.reduceat(np.hstack([v[:block], pair]), first, axis=0)
    n = np.maximum(counts, 1)[:, None]
    return np.hstack([sums / n, np.log1p(counts)[:, None] / 10]).astype(np.float32)


class Network:
    """Two layers: tanh, then one logit; inputs are standardised, probabilities have a temperature."""

    def __init__(self, size: int, hidden: int = 32, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = np.zeros(size), np.ones(size), 1.0
        self.weights = [rng.standard_normal((size, hidden)) / np.sqrt(size), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 2) -> Network:
        """Adam on the logistic loss; the last fifth of the rows sets the temperature.  With one class or none, every probability is the smoothed share of ones."""
        if len(y) < 10 or y.min() == y.max():
            share = (y.sum() + 1) / (len(y) + 2)
            self.weights = [np.zeros_like(w) for w in self.weights]
            self.weights[3][:] = np.log(share / (1 - share))
            return self
        rng = np.random.default_rng(seed)
        cut = max(1, len(y) * 4 // 5)
        x = x.astype(np.float64)
        self.mean, self.scale = x[:cut].mean(axis=0), x[:cut].std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        turn = 0
        for _ in range(rounds):
            order = rng.permutation(cut)
            for low in range(0, cut, batch):
                rows = order[low : low + batch]
                a, b, c, d = self.weights
                h = np.tanh(z[rows] @ a + b)
                slope = (sigmoid(h @ c + d) - y[rows]) / len(rows)
                inner = slope[:, None] * c * (1 - h * h)
                turn += 1
                for k, g in enumerate((z[rows].T @ inner + decay * a, inner.sum(axis=0), h.T @ slope + decay * c, slope.sum(keepdims=True))):
                    m, s = moments[k]
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    self.weights[k] = self.weights[k] - rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.999**turn)) + 1e-8)
        if cut < len(y):
            z, own = self.logits(x[cut:]), y[cut:]
            loss = lambda t: np.logaddexp(0, np.where(own == 1, -z, z) / t).mean()
            self.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
        return self


def train(df: DataFrame, labels: DataFrame, most: int = 12000, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Network]:
    """Word vectors from all texts of ``df``, and a network fitted on at most ``most`` labelled rows.

    ``labels``: doc_id, quality (0 or 1).  Rows of the held-out fold give no
    label; the rows are the first by a hash of their id, and of rows that
    repeat an id the one of the least text.
    """
    vectors = word_vectors(df, text_col)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` rows are sent out, and as many rows of numbers come back
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [pool([t for t, in group], vectors) for group in slices(((t,) for t in b.column("text").to_pylist()), 2_000_000)]
            x = np.vstack(parts) if parts else np.zeros((0, 2 * SIZE + 1), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), lists], ["doc_id", "quality", "x"])

    found = rows.mapInArrow(features, "doc_id bigint, quality int, x array<float>").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    x = np.array([r["x"] for r in found], np.float32).reshape(len(found), -1) if found else np.zeros((0, 2 * SIZE + 1), np.float32)
    return vectors, Network(2 * SIZE + 1).fit(x, np.array([r["quality"] for r in found], np.float64))


def score_quality(df: DataFrame, model: tuple[np.ndarray, Network], text_col: str = "text", slice_bytes: int = 2_000_000) -> DataFrame:
    """All columns of ``df`` and ``quality`` (0 to 1); null and empty texts get the score of no words.  A column of that name gives way."""
    vectors, network = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for group in slices(((t or b"",) for t in b.column(len(b.schema) - 1).to_pylist()), slice_bytes):
                out.append(network.probabilities(pool([t for t, in group], vectors)))
            scores = pa.array(np.concatenate(out) if out else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], scores], schema=b.schema.remove(len(b.schema) - 1).append(pa.field("quality", pa.float64())))

    return scored(df, score, "quality", text_col)
