"""Topic models with their parameters in tables, and the store that publishes them."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import topics
from wordloom.operators.topic_models import Cells, GibbsTopics, OnlineTopics, Settings, concentration, concentration_of, digamma, expectation, logsumexp
from wordloom.sources.models import ModelStore


def blocks(spark, docs=40, count=5):
    """Documents of two kinds that share no word and no feature."""
    rows = [(d, w, w % 2 + 1 + 2 * (d % 2), 0, count) for d in range(docs) for w in ((1, 2, 3) if d % 2 else (4, 5, 6))]
    return spark.createDataFrame(rows, "doc long, word int, feat int, feat2 int, count int")


def tops(model, spark, n=3):
    best = topics.top_items(model.tables(spark)["word"], n).groupBy("topic").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return sorted(r["items"] for r in best.collect())


SMALL = Settings(topics=2, sizes=(7, 5), alpha=0.1, eta=0.1, batch=40, tau=1.0, kappa=0.5, cell=30)


def test_gibbs_finds_two_blocks(spark):
    model = GibbsTopics(SMALL, burn_in=3).fit(blocks(spark), 8)
    assert tops(model, spark) == [[1, 2, 3], [4, 5, 6]]
    mix = {}
    for r in model.mixtures().collect():
        mix.setdefault(r["doc"], []).append(r["p"])
    assert len(mix) == 40 and all(abs(sum(p) - 1) < 1e-9 for p in mix.values())
    assert np.mean([max(p) for p in mix.values()]) > 0.9
    assert model.trace[-1][1] > model.trace[0][1] and [t for t, _ in model.trace] == list(range(1, 9))
    assert model.averages.filter("kind = 0").count() == 7
    sums = model.averages.filter("kind = 0").select(*(F.sum(F.get("values", k)).alias(f"s{k}") for k in range(2))).first()
    assert np.allclose([*sums], 5)  # five sweeps after the burn-in


def parameters(model):
    return {(r["kind"], r["id"]): r["values"] for r in model.parameters.collect()}


def test_a_resumed_run_equals_an_unbroken_one(spark, tmp_path):
    corpus, store = blocks(spark), ModelStore(spark, str(tmp_path))
    whole = GibbsTopics(SMALL).fit(corpus, 4)
    GibbsTopics(SMALL).fit(corpus, 2, store)
    again = GibbsTopics(SMALL).fit(corpus, 4, store)
    a, b = parameters(whole), parameters(again)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    assert np.allclose(whole.priors, again.priors) and np.allclose(whole.trace, again.trace)
    assert store.load()[1] == 4
    with pytest.raises(ValueError, match="other settings"):
        GibbsTopics(Settings(topics=3, sizes=(7, 5))).fit(corpus, 4, store)


def test_a_sweep_depends_on_the_mixtures_before_it(spark):
    corpus = blocks(spark)
    cells = Cells(corpus, 2, 30, split=True)
    model = GibbsTopics(SMALL)
    model.begin(cells)
    start = model.parameters
    model.sweep(cells)
    a = parameters(model)
    other = GibbsTopics(SMALL)
    other.begin(cells)
    # the same words and features, all mixtures turned over
    other.parameters = start.withColumn("values", F.when(F.col("kind") == 2, F.reverse("values")).otherwise(F.col("values")))
    other.sweep(cells)
    b = parameters(other)
    assert any(not np.allclose(a[k], b[k]) for k in a if k[0] == 0)


def test_cells_split_long_documents(spark):
    corpus = spark.createDataFrame([(1 if i % 2 else i, i % 500, 0, 0, 1) for i in range(2000)], "doc long, word int, feat int, feat2 int, count int")
    size = lambda split: max(r["count"] for r in Cells(corpus, 1, 50, split).rows.groupBy("cell").count().collect())
    assert size(True) < 150 <= size(False)
    assert Cells(corpus, 1, 50, True).rows.agg(F.sum("count")).first()[0] == 2000


def test_online_equals_plain_numpy(spark):
    """One update over all documents against the same steps in numpy."""
    corpus = blocks(spark, 10)
    model = OnlineTopics(SMALL)
    model.begin(spark)
    first = parameters(model)
    model.update(corpus, 10, inner=20, tolerance=0.0)
    lam = [np.array([first[m, i] for i in range(size)]).T for m, size in enumerate(SMALL.sizes)]
    logs = []
    for m, x in enumerate(lam):
        total = x.sum(axis=1) if m == 0 else x[:, 1:].sum(axis=1) * 5 / 4
        logs.append(digamma(x) - digamma(total)[:, None])
    logs[1][:, 0] = 0
    stats, bound = [np.zeros_like(x) for x in lam], 0.0
    rows = corpus.orderBy("doc", "word").toPandas()
    for _, doc in rows.groupby("doc"):
        w, c = (logs[0][:, doc["word"]] + logs[1][:, doc["feat"]]), doc["count"].to_numpy(float)
        gamma = np.full(2, 0.1 + c.sum() / 2)
        for _ in range(20):
            mixed = expectation(gamma)[:, None] + w
            share = np.exp(mixed - logsumexp(mixed, axis=0))
            gamma = 0.1 + share @ c
        for m, col in enumerate(("word", "feat")):
            np.add.at(stats[m].T, doc[col], (share * c).T)
        bound += float((c * logsumexp(expectation(gamma)[:, None] + w, axis=0)).sum())
    rate = 2.0**-0.5
    found = parameters(model)
    for m, x in enumerate(lam):
        new = (1 - rate) * x + rate * (0.1 + stats[m])
        for i in range(1 if m else 0, SMALL.sizes[m]):
            assert np.allclose(found[m, i], new[:, i])
    assert model.trace[0][1] == pytest.approx(bound)


def test_online_finds_two_blocks_and_resumes(spark, tmp_path):
    corpus, store = blocks(spark), ModelStore(spark, str(tmp_path))
    settings = replace(SMALL, alpha=1.0)
    whole = OnlineTopics(settings).fit(corpus, 5)
    OnlineTopics(settings).fit(corpus, 3, store)
    again = OnlineTopics(settings).fit(corpus, 5, store)
    assert tops(whole, spark) == [[1, 2, 3], [4, 5, 6]]
    a, b = parameters(whole), parameters(again)
    assert all(np.allclose(a[k], b[k]) for k in a) and np.allclose(whole.trace, again.trace)


def test_wrong_sizes_are_told(spark):
    with pytest.raises(Exception, match="are the sizes right"):
        GibbsTopics(Settings(topics=2, sizes=(3, 5))).fit(blocks(spark), 1)


def test_concentration():
    shares = np.random.default_rng(0).dirichlet(np.full(20, 0.5), 3000)
    assert concentration(shares, 1.0, steps=50) == pytest.approx(0.5, rel=0.05)
    assert concentration_of(20, float(np.log(np.clip(shares, 1e-100, None)).mean()), 1.0, 50) == concentration(shares, 1.0, 50)
    assert concentration_of(1, 0.0, 0.7) == 0.7


def test_a_broken_save_leaves_the_last_model(spark, tmp_path, monkeypatch):
    store = ModelStore(spark, str(tmp_path / "m"))
    assert store.load() is None and store.versions() == {}
    table = lambda x: {"t": spark.createDataFrame([(x,)], "x double")}
    store.publish(table(1.0), 1, {"note": "first"})

    def broken(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(store, "_point", broken)  # all is written, the pointer is not
        with pytest.raises(OSError):
            store.publish(table(2.0), 2)
    with pytest.raises(ValueError, match="undefined"):
        store.publish(table(float("nan")), 3)
    with pytest.raises(Exception):  # noqa: B017 - a table that cannot be written
        store.publish({"t": spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))}, 4)
    tables, iteration, facts = ModelStore(spark, str(tmp_path / "m")).load()
    assert (tables["t"].first()["x"], iteration, facts) == (1.0, 1, {"note": "first"})
    store.publish(table(5.0), 5)
    assert store.load()[0]["t"].first()["x"] == 5.0 and store.load(1)[0]["t"].first()["x"] == 1.0
    store.prune(1)
    assert store.load(1) is None and store.load()[1] == 5 and list(store.versions().values()) == [5]
