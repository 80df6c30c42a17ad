"""Inspection and evaluation of topic models, whose tables are long: (topic, item, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wordloom.functions.columns import divide
from wordloom.operators.stats import percentile_rank, spearman, weighted_summary


def top_items(model: DataFrame, count: int = 15, floor: float = 1e-4) -> DataFrame:
    """(topic, rank, item, p): each topic's likeliest items above ``floor``, shares taken of the topic's sum."""
    shares = model.withColumn("p", divide(F.col("p"), F.sum("p").over(W.partitionBy("topic")))).filter(F.col("p") > floor)
    best = W.partitionBy("topic").orderBy(F.col("p").desc(), "item")
    return shares.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= count).select("topic", "rank", "item", "p")


def side_by_side(rows: DataFrame, *columns: str, extra: int = 2, connector: str = " | ") -> DataFrame:
    """``rows`` with ``line``: columns as text, each padded to its longest value and ``extra`` blanks, joined by ``connector``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    widest = rows.agg(*(F.coalesce(F.max(F.length(text(c))), F.lit(0)).alias(f"_w{k}") for k, c in enumerate(columns)))
    padded = [F.concat(text(c), F.repeat(F.lit(" "), F.col(f"_w{k}") + extra - F.length(text(c)))) for k, c in enumerate(columns)]
    return rows.crossJoin(F.broadcast(widest)).withColumn("line", F.concat_ws(connector, *padded)).drop(*(f"_w{k}" for k in range(len(columns))))


def document_topics(mixtures: DataFrame, floor: float = 1e-6) -> DataFrame:
    """(doc, rank, topic, p): a document's topics above ``floor``, heaviest first."""
    return mixtures.filter(F.col("p") > floor).withColumn("rank", F.row_number().over(W.partitionBy("doc").orderBy(F.col("p").desc(), "topic"))).select("doc", "rank", "topic", "p")


def word_topics(model: DataFrame, floor: float = 0.05, normalise: bool = True) -> DataFrame:
    """(item, topic, p): topics given an item, above ``floor``."""
    p = divide(F.col("p"), F.sum("p").over(W.partitionBy("item"))) if normalise else F.col("p")
    return model.select("item", "topic", p.alias("p")).filter(F.col("p") > floor)


def topic_lmi(model: DataFrame) -> DataFrame:
    """p(w, t) ln(p(w | t) / p(t)) with p(t) from the table's sums, negatives as 0."""
    total = model.agg(F.sum("p").alias("total"))
    own = F.sum("p").over(W.partitionBy("topic"))
    joined = model.crossJoin(F.broadcast(total)).withColumns({"_t": own, "_j": divide(F.col("p"), F.col("total"))})
    value = F.when(F.col("p") > 0, F.greatest(F.col("_j") * F.ln(divide(F.col("p"), F.col("_t")) / divide(F.col("_t"), F.col("total"))), F.lit(0.0))).otherwise(0.0)
    return joined.select("topic", "item", value.alias("p"))


def predicted_associations(divergences: DataFrame, norms: DataFrame) -> DataFrame:
    """Weighted percentiles of norms (cue, response, count) under divergences (left, right, js) of each cue with all words."""
    ranks = percentile_rank(divergences, "js", "left", descending=True)
    hits = norms.join(ranks, (norms["cue"] == ranks["left"]) & (norms["response"] == ranks["right"])).groupBy("cue", "response").agg(F.max("count").alias("count"), F.max("pct").alias("pct"))
    return weighted_summary(hits, "pct", "count")


def against_gold(measures: DataFrame, gold: DataFrame, names: list[str]) -> DataFrame:
    """(measure, rho, n) of pair measures against gold similarities (left, right, similarity); a repeated pair counts once (Q28)."""
    joined = gold.groupBy("left", "right").agg(F.max("similarity").alias("similarity")).join(measures, ["left", "right"])
    each = F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in names)))
    return spearman(joined.select("similarity", each), "similarity", "value", "measure")


def cumulative_time(trace: DataFrame) -> DataFrame:
    """(model, iter, value, seconds, elapsed) of traces (model, at, value, seconds), iterations from 1."""
    order = W.partitionBy("model").orderBy("at", "value", "seconds")
    return trace.select("model", F.row_number().over(order).alias("iter"), "value", "seconds", F.sum("seconds").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("elapsed"))


def final_value(trace: DataFrame, last: int = 5) -> DataFrame:
    """(model, value, seconds): mean of the last values and all time."""
    back = F.row_number().over(W.partitionBy("model").orderBy(F.col("at").desc(), F.col("value").desc(), F.col("seconds").desc()))
    return trace.withColumn("_b", back).groupBy("model").agg(F.avg(F.when(F.col("_b") <= last, F.col("value"))).alias("value"), F.sum("seconds").alias("seconds"))


# Tags of the corpus for a part of speech of a gold table, in order of preference.
TAGS = {
    "ADJ": ["ADJA", "ADJD"],
    "NN": ["NN"],
    "SUBJ": ["NN"],
    "OBJ": ["NN"],
    "V": ["VVFIN", "VVINF", "VVPP", "VVIZU", "VVIMP"],
}
ANY_TAG = ["NN", "ADJA", "ADJD", "VVFIN", "VVINF", "VVPP", "VVIZU", "VVIMP"]


def resolve_tags(words: DataFrame, vocabulary: DataFrame, tags: dict[str, list[str]] | None = None) -> DataFrame:
    """(word, pos, label): the first tagged form of a word that the vocabulary (label) has; words without one leave.

    ``words``: (word, pos); an unknown or null pos tries all tags.
    """
    tags = tags or TAGS
    table = F.create_map(*(x for k, v in tags.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    order = F.coalesce(F.element_at(table, F.col("pos")), F.array(*map(F.lit, ANY_TAG)))
    tries = words.select("word", "pos", F.posexplode(order).alias("place", "tag")).withColumn("label", F.concat_ws("/", "word", "tag"))
    return tries.join(vocabulary.select("label").distinct(), "label", "left_semi").groupBy("word", "pos").agg(F.min_by("label", "place").alias("label"))
