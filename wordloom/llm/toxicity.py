"""Toxicity by non-negative positive-unlabelled learning (operator 7).

A linear numpy classifier over hashed words is trained from confirmed toxic
texts and from texts without labels.  Its risk is prior * R_p(+) plus the part
of the unlabelled risk that the prior does not explain, R_u(-) - prior * R_p(-),
which is kept from falling below zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.pretokens import slices
from wordloom.llm.shared import held_out
from wordloom.llm.words import tokens

BUCKETS = 1 << 18


def distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct buckets in a row, and their number by text."""
    found, counts = tokens(texts, BUCKETS)
    pairs = np.unique(np.repeat(np.arange(len(texts)), counts).astype(np.int64) * BUCKETS + found)
    return (pairs % BUCKETS).astype(np.int32), np.bincount(pairs // BUCKETS, minlength=len(texts))


def logits(weights: np.ndarray, bias: float, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bias plus the weights of each text's words."""
    sums = np.concatenate([[0.0], np.cumsum(weights[words], dtype=np.float64)])
    ends = np.cumsum(counts)
    return bias + sums[ends] - sums[ends - counts]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


def risks(w: np.ndarray, positive: tuple, unlabelled: tuple, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """prior * R_p(+), R_u(-) - prior * R_p(-), and the gradient of each; the last entry of ``w`` is the bias.

    A set of texts is (text numbers, their words' columns, number of texts).
    """

    def gradient(of: tuple, slope: np.ndarray) -> np.ndarray:
        row, col, n = of
        return np.append(np.bincount(col, slope[row], len(w) - 1), slope.sum()) / n

    p, u = (sigmoid(np.bincount(row, w[col], n) + w[-1]) for row, col, n in (positive, unlabelled))
    log = lambda x: np.log(np.clip(x, 1e-12, 1))
    rest = -log(1 - u).mean() + prior * log(1 - p).mean()
    return -prior * log(p).mean(), rest, prior * gradient(positive, p - 1), gradient(unlabelled, u) - prior * gradient(positive, p)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 120, rate: float = 0.1, decay: float = 6e-3, least: int = 4) -> tuple[np.ndarray, float]:
    """Weights by bucket and bias, by full-batch Adam on the non-negative risk with the logistic loss.

    A text is the array of its distinct buckets.
    Words of fewer than ``least`` training texts keep weight 0, as do those whose
    weight the first half of the rounds, with decay, leaves small.  Without
    positive or unlabelled texts every score is the prior.  The decay falls with
    the square root of the number of positive texts.
    """
    weights = np.zeros(BUCKETS, np.float32)
    start = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not positive or not unlabelled:
        return weights, start
    texts = np.zeros(BUCKETS, np.int64)
    for words in (*positive, *unlabelled):
        texts[words] += 1
    known = np.flatnonzero(texts >= least)
    column = np.full(BUCKETS, -1, np.int32)
    column[known] = np.arange(len(known))
    sets = []
    for part in (positive, unlabelled):
        cols = [column[words] for words in part]
        cols = [c[c >= 0] for c in cols]
        sets.append((np.repeat(np.arange(len(part), dtype=np.int32), [len(c) for c in cols]), np.concatenate(cols), len(part)))
    w, mean, square = np.zeros(len(known) + 1), np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    w[-1] = start
    decay = decay / np.sqrt(len(positive))

    free = np.ones(len(w), bool)
    for turn in range(1, 2 * rounds + 1):
        if turn == rounds + 1:  # words without a clear weight leave; the others are fitted again without decay
            free[:-1] = np.abs(w[:-1]) >= 0.2
            w[~free] = 0.0
            decay = 0.0
        _, rest, of_positive, of_rest = risks(w, sets[0], sets[1], prior)
        g = of_positive + of_rest if rest >= 0 else -of_rest  # below zero the estimate overfits: step back
        g[:-1] += decay * np.sign(w[:-1])
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= free * rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
    weights[known] = w[:-1]
    return weights, float(w[-1])


def train(df: DataFrame, labels: DataFrame, most_positive: int = 4000, most_unlabelled: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Fit on at most ``most_positive`` toxic and ``most_unlabelled`` other texts, the first by a hash of their id.

    Labels come from ``labels`` (doc_id, toxic); rows of the held-out fold are
    used in no way, and of rows that repeat an id the one of the least text is.
    The prior is the toxic share of the usable labels.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    first = lambda ids, n: ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    ids = first(known.filter("toxic = 1"), most_positive).withColumn("kind", F.lit(1)).unionByName(first(docs, most_unlabelled).withColumn("kind", F.lit(0)))
    # at most most_positive + most_unlabelled rows, small enough to send; their words come back, not their texts
    rows = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "kind").agg(F.min(F.coalesce("text", F.lit(""))).cast("binary").alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in slices(zip(*(b.column(c).to_pylist() for c in ("text", "doc_id", "kind")), strict=True), 4_000_000):
                found, counts = distinct_words([t for t, _, _ in group])
                each = [x.tobytes() for x in np.split(found, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array([i for _, i, _ in group], pa.int64()), pa.array([k for _, _, k in group], pa.int32()), pa.array(each, pa.binary())], ["doc_id", "kind", "words"])

    texts: tuple[list, list] = ([], [])
    for r in rows.mapInArrow(words, "doc_id bigint, kind int, words binary").orderBy("kind", F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        texts[r["kind"]].append(np.frombuffer(r["words"], np.int32))
    return fit(texts[1], texts[0], float(share or 0.0))


def score_toxicity(df: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 4_000_000) -> DataFrame:
    """All columns of ``df`` and ``toxicity`` (0 to 1); null and empty texts get the score of no words.  A column of that name gives way."""
    weights, bias = model
    used = np.flatnonzero(weights)
    sparse = (used, weights[used])  # few words have a weight

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(BUCKETS, np.float32)
        full[sparse[0]] = sparse[1]
        for b in batches:
            out = []
            texts = ((t or b"",) for t in b.column(len(b.schema) - 1).to_pylist())
            for group in slices(texts, slice_bytes):
                out.append(sigmoid(logits(full, bias, *distinct_words([t for t, in group]))))
            scores = pa.array(np.concatenate(out) if out else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], scores], schema=b.schema.remove(len(b.schema) - 1).append(pa.field("toxicity", pa.float64())))

    return scored(df, score, "toxicity", text_col)


def scored(df: DataFrame, score, name: str, text_col: str) -> DataFrame:
    """Run ``score`` over the rows; the last column it gets is the text as bytes, which it replaces by ``name``."""
    from pyspark.sql import types as T

    df = df.drop(name)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return df.select("*", F.col(f"`{text_col}`").cast("string").cast("binary").alias(f"{name}_text")).mapInArrow(score, schema)
