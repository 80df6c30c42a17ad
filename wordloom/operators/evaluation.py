"""Topic models against gold similarities of word pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators import similarity, topics
from wordloom.operators.stats import order_accuracy, spearman_p

#: Measures of a pair, with 1 if likeness grows with it and -1 if it falls.
MEASURES = {"right_given_left": 1, "left_given_right": 1, "js": -1, "symkl": -1, "kl": -1, "kl_reversed": -1, "cosine_lmi": 1}


def pair_measures(model: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, one column a measure) for pairs of words that the model (topic, item, p) has.

    Association of either word given the other, divergences between the words'
    topics, and the cosine of their local mutual information with topics.
    """
    loads = model.select(F.col("item").alias("word"), "topic", "p")
    shares = topics.word_topics(model, floor=0.0).select(F.col("item").alias("word"), "topic", "p")
    lmi = topics.topic_lmi(model).select(F.col("item").alias("target"), F.col("topic").cast("string").alias("context"), F.col("p").alias("value"))
    cosine = similarity.distances(lmi, pairs, "cosine").withColumnRenamed("cosine", "cosine_lmi")
    key = ["left", "right"]
    out = similarity.conditional(loads, pairs).join(similarity.divergences(shares, pairs), key).join(cosine, key, "left")
    return out.select(*key, *MEASURES)


def against_gold(model: DataFrame, gold: DataFrame, gap: float = 1.0) -> DataFrame:
    """(measure, rho, n, p, pairs, accuracy, baseline) of each measure against gold (left, right, similarity).

    Rank correlation with its p-value, and the share of gold pairs, at least
    ``gap`` apart, that the measure orders alike; divergences count as
    unlikeness.  A repeated pair counts once; pairs of unknown words leave.
    """
    names = list(MEASURES)
    measures = pair_measures(model, gold.select("left", "right").distinct())
    # rounded, as equal sums may differ in their last bits with the order of the topics
    measures = measures.select("left", "right", *(F.round(m, 9).alias(m) for m in names))
    rho = topics.against_gold(measures, gold, names).withColumn("p", spearman_p("rho", "n"))
    once = gold.groupBy("left", "right").agg(F.max("similarity").alias("gold")).join(measures, ["left", "right"])
    signed = once.select(F.concat_ws("\t", "left", "right").alias("id"), "gold", *((F.col(m) if sign > 0 else -F.col(m)).alias(m) for m, sign in MEASURES.items()))
    return rho.join(order_accuracy(signed, names, gap), "measure", "left")
