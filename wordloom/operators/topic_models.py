"""Topic models over words and any number of feature modalities, with all parameters in tables.

Tokens are dealt into cells of bounded size.  In every round each cell gets the
parameters of the words, features and documents that it holds, and returns sums
by those; they are added up and make the next parameters.  On the driver are
numbers by topic only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.draws import standard_gammas
from wordloom.functions.scratch import remove, scratch_dir, stored
from wordloom.sources.models import ModelStore

MODALITIES = ("word", "feat", "feat2")
TOKEN = -1
PARAMETERS = "kind int, id bigint, values array<double>"


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma: recurrence up to 6, then the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def expectation(parameters: np.ndarray) -> np.ndarray:
    """E[log p] under Dirichlet rows."""
    p = np.atleast_2d(parameters)
    return (digamma(p) - digamma(p.sum(axis=1, keepdims=True))).reshape(np.shape(parameters))


def logsumexp(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def concentration(shares: np.ndarray, prior: float, steps: int = 5, least: float = 1e-4) -> float:
    """Symmetric Dirichlet parameter of the rows, by Newton steps on its reciprocal."""
    return concentration_of(shares.shape[1], float(np.log(np.clip(shares, 1e-100, None)).mean()), prior, steps, least)


def concentration_of(k: int, target: float, prior: float, steps: int = 5, least: float = 1e-4) -> float:
    """As ``concentration``, from the mean logarithm of shares over ``k`` entries."""
    if k < 2:
        return prior
    for _ in range(steps):
        slope = k * (digamma(np.array([k * prior]))[0] - digamma(np.array([prior]))[0] + target)
        small = prior * 1e-4
        curve = k * ((digamma(np.array([k * (prior + small)]))[0] - digamma(np.array([prior + small]))[0]) - (digamma(np.array([k * prior]))[0] - digamma(np.array([prior]))[0])) / small
        inverse = 1 / prior
        first, second = -slope * prior**2, curve * prior**4 + 2 * slope * prior**3
        change = -first / second if second < 0 else np.sign(first) * 0.1 * inverse
        new = max(inverse + change, inverse / 10)
        if abs(new - inverse) < 1e-6 * inverse:
            break
        prior = max(least, 1 / new)
    return prior


@dataclass
class Settings:
    topics: int = 100
    sizes: tuple[int, ...] = (0,)  # entries of each modality, numbers from 0
    alpha: float | None = None
    eta: float | None = None
    tau: float = 32.0
    kappa: float = 0.7
    batch: int = 1024
    seed: int = 42
    cell: int = 20_000  # tokens' rows in a cell, about

    @property
    def prior(self) -> float:
        return self.alpha if self.alpha is not None else 1.0 / self.topics

    def smoothing(self, m: int) -> float:
        return self.eta if self.eta is not None else 1.0 / max(1, self.sizes[m])


class Cells:
    """A corpus dealt into cells: rows (cell, doc, word, feat, feat2, count), and what parameters each cell needs.

    Documents are dealt by their hash; where ``split``, cells of too many rows
    are dealt further by word, so that one long document is no task of its own.
    """

    def __init__(self, corpus: DataFrame, used: int, size: int, split: bool):
        blocks = max(1, -(-corpus.count() // size))
        rows = corpus.select("doc", *(F.col(c) if k < used else F.lit(0).alias(c) for k, c in enumerate(MODALITIES)), "count").groupBy("doc", *MODALITIES).agg(F.sum("count").alias("count"))
        rows = rows.withColumn("_block", F.pmod(F.xxhash64("doc"), F.lit(blocks)))
        part = F.lit(0).cast("bigint")
        if split:
            rows = stored(rows)
            rows = rows.join(rows.groupBy("_block").agg(F.ceil(F.count("*") / F.lit(2 * size)).alias("_parts")), "_block")
            part = F.pmod(F.xxhash64("word"), F.col("_parts"))
        self.rows = stored(rows.select((F.col("_block") * 2**20 + part).alias("cell"), "doc", *MODALITIES, "count"))
        kinds = [F.struct(F.lit(k).alias("kind"), F.col(c).cast("bigint").alias("id")) for k, c in enumerate((*MODALITIES[:used], "doc"))]
        self.needs = stored(self.rows.select("cell", F.inline(F.array(*kinds))).distinct())

    def run(self, parameters: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """``work`` on each cell: its rows of tokens (kind TOKEN, id: document, a, b, c, n) and of parameters (kind, id, values)."""
        none = F.lit(None).cast("array<double>").alias("values")
        tokens = self.rows.select("cell", F.lit(TOKEN).alias("kind"), F.col("doc").cast("bigint").alias("id"), *(F.col(c).cast("bigint").alias(x) for c, x in zip(MODALITIES, "abc", strict=True)), F.col("count").cast("bigint").alias("n"), none)
        zero = [F.lit(0).cast("bigint").alias(x) for x in "abcn"]
        known = self.needs.join(parameters, ["kind", "id"], "left").select("cell", "kind", "id", *zero, "values")
        return tokens.unionByName(known).groupBy("cell").applyInArrow(work, schema)


def _opened(table: pa.Table, topics: int, kinds: int) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Tokens of a cell in a fixed order, and for each kind its ids, rising, and their parameters."""
    kind = np.asarray(table.column("kind"))
    own = table.filter(pa.array(kind == TOKEN))
    tokens = {c: np.asarray(own.column(c)) for c in ("id", "a", "b", "c", "n")}
    order = np.lexsort([tokens[c] for c in ("c", "b", "a", "id")])
    ids, values = [], []
    for k in range(kinds):
        part = table.filter(pa.array(kind == k))
        if part.column("values").null_count:
            missing = part.filter(part.column("values").is_null()).column("id")[0]
            raise ValueError(f"no parameters for number {missing} of kind {k}: are the sizes right?")
        at = np.argsort(np.asarray(part.column("id")))
        ids.append(np.asarray(part.column("id"))[at])
        values.append(np.asarray(part.column("values").combine_chunks().flatten()).reshape(-1, topics)[at])
    return {c: x[order] for c, x in tokens.items()}, ids, values


def _summed(counts: list[np.ndarray], ids: list[np.ndarray], fit: float) -> pa.Table:
    """Rows (kind, id, topic, n, fit) of what is not 0."""
    rows = [(np.full(len(at[0]), k), ids[k][at[0]], at[1], x[at]) for k, x in enumerate(counts) for at in [np.nonzero(x)]]
    columns = [np.concatenate([r[j] for r in rows] + [[v]]) for j, v in enumerate((-2, 0, 0, 0))]
    fits = np.zeros(len(columns[0]))
    fits[-1] = fit
    return pa.table({"kind": pa.array(columns[0], pa.int32()), "id": pa.array(columns[1], pa.int64()), "topic": pa.array(columns[2], pa.int32()), "n": pa.array(columns[3], pa.float64()), "fit": pa.array(fits)})


SUMS = "kind int, id bigint, topic int, n double, fit double"


class _Model:
    """What both kinds of models share: parameters by kind and id, their sums by topic, a trace, a store."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.parameters: DataFrame | None = None
        self.sums: list[list[float]] = []
        self.done = 0
        self.trace: list[tuple[int, float]] = []
        self._base: str | None = None

    def _entries(self, spark: SparkSession) -> DataFrame:
        """(kind, id) of all entries of all modalities."""
        sizes = F.array(*map(F.lit, self.s.sizes))
        return spark.range(max(self.s.sizes)).select("id", F.posexplode(sizes).alias("kind", "size")).filter("id < size").select("kind", "id")

    def _add_up(self) -> None:
        """Sums by topic of each modality; a feature number 0 means none and takes no part."""
        k = self.s.topics
        found = self.parameters.filter((F.col("kind") == 0) | (F.col("kind") < len(self.s.sizes)) & (F.col("id") > 0)).groupBy("kind").agg(F.array(*(F.sum(F.get("values", t)) for t in range(k))).alias("sums")).collect()
        self.sums = [[1.0] * k for _ in self.s.sizes]
        for r in found:
            self.sums[r["kind"]] = list(r["sums"])

    def _keep(self, parameters: DataFrame, turn: int) -> None:
        """Write the parameters of a round; those of the round before last go."""
        spark = parameters.sparkSession
        self._base = self._base or scratch_dir(spark)
        self.parameters = stored(parameters, f"{self._base}/round-{turn}")
        remove(spark, f"{self._base}/round-{turn - 2}")
        self._add_up()
        self.done = turn

    def _facts(self) -> dict:
        return {"settings": asdict(self.s), "sums": self.sums, "trace": self.trace}

    def publish(self, store: ModelStore) -> None:
        store.publish({"parameters": self.parameters}, self.done, self._facts())

    def restore(self, store: ModelStore) -> bool:
        """Take up the last published model; False if there is none."""
        found = store.load()
        if found is None:
            return False
        tables, self.done, facts = found
        if facts["settings"] | {"sizes": tuple(facts["settings"]["sizes"])} != asdict(self.s):
            raise ValueError("the stored model has other settings")
        self.parameters, self.sums, self.trace = tables["parameters"], facts["sums"], [tuple(t) for t in facts["trace"]]
        self._resume(facts)
        return True

    def _resume(self, facts: dict) -> None:
        pass

    def shares(self, kind: int) -> DataFrame:
        """(topic, item, p) of a modality: a distribution over items for each topic."""
        sums = F.array(*map(F.lit, self.sums[kind]))
        rows = self.parameters.filter((F.col("kind") == kind) & ((F.col("id") > 0) | F.lit(kind == 0)))
        return rows.select(F.posexplode(F.zip_with("values", sums, lambda v, s: v / s)).alias("topic", "p"), F.col("id").cast("int").alias("item")).select("topic", "item", "p")

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The model in long form: a table (topic, item, p) a modality, and the trace."""
        out = {MODALITIES[m]: self.shares(m) for m in range(len(self.s.sizes))}
        return out | {"trace": spark.createDataFrame(self.trace, "iter int, value double")}


class OnlineTopics(_Model):
    """Online variational Bayes for one to three modalities (Hoffman et al. 2010; Andrews et al. 2009).

    Each update takes the documents of one hashed batch; a document's own
    mixture is fitted in one cell.
    """

    def begin(self, spark: SparkSession) -> None:
        k, seed = self.s.topics, self.s.seed

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                values = [np.random.default_rng([seed, m, i]).gamma(100.0, 0.01, k) for m, i in zip(b.column("kind").to_pylist(), b.column("id").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("id"), pa.array([v.tolist() for v in values], pa.list_(pa.float64()))], ["kind", "id", "values"])

        self._keep(self._entries(spark).mapInArrow(draw, PARAMETERS), 0)

    def update(self, docs: DataFrame, all_docs: int, inner: int = 100, tolerance: float | None = None) -> None:
        """One update by the documents of ``docs`` (rows of a corpus), out of ``all_docs``."""
        s, used, sums = self.s, len(self.s.sizes), [np.array(x) for x in self.sums]
        near = s.topics * 0.001 if tolerance is None else tolerance
        # features of number 0 count as one more entry of mean size
        whole = [x if m == 0 or s.sizes[m] < 2 else x * s.sizes[m] / (s.sizes[m] - 1) for m, x in enumerate(sums)]

        def fit(table: pa.Table) -> pa.Table:
            tokens, ids, values = _opened(table, s.topics, used)
            logs = [digamma(v) - digamma(t) for v, t in zip(values, whole, strict=True)]
            places = [np.searchsorted(ids[m], tokens["abc"[m]]) for m in range(used)]
            for m in range(1, used):
                logs[m][ids[m] == 0] = 0.0
            weight = sum(x[p] for x, p in zip(logs, places, strict=True))
            counts = tokens["n"].astype(float)
            stats = [np.zeros_like(v) for v in values]
            names, doc = np.unique(tokens["id"], return_inverse=True)  # tokens stand by document
            gamma = s.prior + np.repeat(np.bincount(doc, counts)[:, None], s.topics, axis=1) / s.topics
            loads = np.zeros_like(weight)
            open_ = np.ones(len(names), bool)
            for _ in range(inner):  # all documents at once; those that have settled rest
                at = np.flatnonzero(open_[doc])
                own, starts = np.unique(doc[at], return_index=True)
                mixed = expectation(gamma)[doc[at]] + weight[at]
                loads[at] = np.exp(mixed - logsumexp(mixed)[:, None]) * counts[at, None]
                new = s.prior + np.add.reduceat(loads[at], starts, axis=0)
                open_[own] = np.abs(new - gamma[own]).mean(axis=1) >= near
                gamma[own] = new
                if not open_.any():
                    break
            for m in range(used):
                np.add.at(stats[m], places[m], loads)
            bound = float((counts * logsumexp(expectation(gamma)[doc] + weight)).sum())
            out = _summed(stats, ids, bound)
            return out.append_column("docs", pa.array([0] * (len(out) - 1) + [len(names)], pa.int64()))

        cells = Cells(docs, used, s.cell, split=False)
        found = stored(cells.run(self.parameters, fit, SUMS + ", docs bigint"))
        bound, n = found.filter("kind = -2").agg(F.sum("fit"), F.sum("docs")).first()
        if not n:
            return
        rate = (s.tau + 1 + self.done) ** -s.kappa
        added = found.filter("kind >= 0").groupBy("kind", "id", "topic").agg(F.sum("n").alias("n")).groupBy("kind", "id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("m"))
        eta = F.element_at(F.array(*(F.lit(s.smoothing(m)) for m in range(used))), F.col("kind") + 1)
        got = lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)) * F.lit(all_docs / n)
        new = self.parameters.join(added, ["kind", "id"], "left").select("kind", "id", F.transform("values", lambda v, k: v * (1 - rate) + (eta + got(k)) * rate).alias("values"))
        self._keep(new, self.done + 1)
        if not np.isfinite(self.sums).all():
            raise ValueError("the model has undefined entries")
        self.trace.append((self.done, bound * all_docs / n))

    def fit(self, corpus: DataFrame, iterations: int = 1000, store: ModelStore | None = None, every: int = 50) -> OnlineTopics:
        """Updates up to the number ``iterations``; with a ``store``, from its last model on, which is published ``every`` so often."""
        corpus = stored(corpus)
        total = corpus.select("doc").distinct().count()
        if self.parameters is None and not (store and self.restore(store)):
            self.begin(corpus.sparkSession)
        batches = max(1, round(total / self.s.batch))
        for turn in range(self.done, iterations):
            self.update(corpus.filter(F.pmod(F.xxhash64("doc", F.lit(turn // batches)), F.lit(batches)) == turn % batches), total)
            if store and ((turn + 1) % every == 0 or turn + 1 == iterations):
                self.publish(store)
        return self


class GibbsTopics(_Model):
    """Gibbs sampling of topics for words and one or two feature modalities.

    A sweep samples the topics of every row from p(topic) ~ phi psi pi, then
    draws phi, psi and each document's pi from their Dirichlet posteriors, whose
    symmetric priors follow.  Draws depend on the seed, the sweep, and the cell
    or the entry alone.  The state between sweeps, mixtures of documents too, is the
    table of parameters, so a sweep goes on from the one before, in this run or
    in one that is taken up from a store.
    """

    def __init__(self, settings: Settings, burn_in: int = 0):
        super().__init__(settings)
        self.burn_in = burn_in
        self.priors = [1.0] * len(settings.sizes) + [settings.prior]
        self.averages: DataFrame | None = None

    def _facts(self) -> dict:
        return super()._facts() | {"priors": self.priors, "burn_in": self.burn_in}

    def _resume(self, facts: dict) -> None:
        self.priors, self.burn_in = facts["priors"], facts["burn_in"]

    def publish(self, store: ModelStore) -> None:
        store.publish({"parameters": self.parameters} | ({"averages": self.averages} if self.averages is not None else {}), self.done, self._facts())

    def restore(self, store: ModelStore) -> bool:
        if not super().restore(store):
            return False
        self.averages = store.load()[0].get("averages")
        return True

    def _draw(self, counts: DataFrame, turn: int) -> None:
        """New parameters from (kind, id, m: counts by topic), and the priors that follow from them."""
        k, used, seed, priors = self.s.topics, len(self.s.sizes), self.s.seed, list(self.priors)

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kind, ids, m = np.asarray(b.column("kind")), np.asarray(b.column("id")), b.column("m")
                n = np.repeat(np.array(priors)[kind][:, None], k, axis=1)
                at = np.asarray(m.offsets)
                held = slice(at[0], at[-1])
                np.add.at(n, (np.repeat(np.arange(len(b)), np.diff(at)), np.asarray(m.keys)[held]), np.asarray(m.items)[held])
                g = np.clip(standard_gammas(n, seed, turn, kind, ids), 1e-10, None)
                g[kind == used] /= g[kind == used].sum(axis=1, keepdims=True)  # a document's mixture
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, g.size + 1, k, dtype=np.int32)), pa.array(g.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("id"), values, pa.array(np.log(g).sum(axis=1))], ["kind", "id", "values", "logs"])

        self._keep(counts.mapInArrow(draw, PARAMETERS + ", logs double"), turn)
        held = (F.col("kind") == 0) | (F.col("kind") == used) | (F.col("id") > 0)
        for r in self.parameters.filter(held).groupBy("kind").agg(F.sum("logs").alias("logs"), F.count("*").alias("n")).collect():
            kind = r["kind"]
            mean = r["logs"] / (r["n"] * k) - (float(np.log(self.sums[kind]).mean()) if kind < used else 0.0)
            self.priors[kind] = concentration_of(r["n"] if kind < used else k, mean, self.priors[kind])

    def begin(self, cells: Cells) -> None:
        docs = cells.needs.filter(F.col("kind") == len(self.s.sizes)).select("kind", "id").distinct()
        entries = self._entries(docs.sparkSession).unionByName(docs)
        self._draw(entries.withColumn("m", F.lit(None).cast("map<int,double>")), 0)

    def sweep(self, cells: Cells) -> None:
        s, used, turn = self.s, len(self.s.sizes), self.done + 1
        sums = [np.log(x) for x in self.sums]

        def sample(table: pa.Table) -> pa.Table:
            tokens, ids, values = _opened(table, s.topics, used + 1)
            logs = [np.clip(np.log(v) - (sums[m] if m < used else 0.0), np.log(1e-10), 0.0) for m, v in enumerate(values)]
            places = [np.searchsorted(ids[m], tokens[c]) for m, c in enumerate((*"abc"[:used], "id"))]
            for m in range(1, used):
                logs[m][ids[m] == 0] = 0.0
            weight = sum(x[p] for x, p in zip(logs, places, strict=True))
            norm = logsumexp(weight)
            p = np.exp(weight - norm[:, None])
            drawn = np.random.default_rng([s.seed, turn, int(table.column("cell")[0].as_py())]).multinomial(tokens["n"], p / p.sum(axis=1, keepdims=True))
            counts = [np.zeros(v.shape) for v in values]
            for m, place in enumerate(places):
                np.add.at(counts[m], place, drawn)
            return _summed(counts, ids, float((tokens["n"] * norm).sum()))

        found = stored(cells.run(self.parameters.select("kind", "id", "values"), sample, SUMS))
        fit = found.filter("kind = -2").agg(F.sum("fit")).first()[0]
        counts = found.filter("kind >= 0").groupBy("kind", "id", "topic").agg(F.sum("n").alias("n")).groupBy("kind", "id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("m"))
        self._draw(self.parameters.select("kind", "id").join(counts, ["kind", "id"], "left"), turn)
        if turn > self.burn_in:
            scale = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in self.sums), F.array(*[F.lit(1.0)] * s.topics)), F.col("kind") + 1)
            share = self.parameters.select("kind", "id", F.zip_with("values", scale, lambda v, t: v / t).alias("values"))
            if self.averages is not None:
                share = share.join(self.averages.withColumnRenamed("values", "_old"), ["kind", "id"], "left").select("kind", "id", F.zip_with("values", "_old", lambda v, o: v + F.coalesce(o, F.lit(0.0))).alias("values"))
            self.averages = stored(share, f"{self._base}/averages-{turn}")
            remove(share.sparkSession, f"{self._base}/averages-{turn - 2}")
        self.trace.append((turn, float(fit or 0.0)))

    def fit(self, corpus: DataFrame, iterations: int = 1000, store: ModelStore | None = None, every: int = 50) -> GibbsTopics:
        """Sweeps up to the number ``iterations``; with a ``store``, from its last model on, which is published ``every`` so often."""
        cells = Cells(corpus, len(self.s.sizes), self.s.cell, split=True)
        if self.parameters is None and not (store and self.restore(store)):
            self.begin(cells)
        for turn in range(self.done + 1, iterations + 1):
            self.sweep(cells)
            if store and (turn % every == 0 or turn == iterations):
                self.publish(store)
        return self

    def mixtures(self) -> DataFrame:
        """(doc, topic, p): the mixture of each document."""
        return self.parameters.filter(F.col("kind") == len(self.s.sizes)).select(F.col("id").alias("doc"), F.posexplode("values").alias("topic", "p"))
