"""The driver's tables in the shapes that the operators take, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.columns import uniform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, context, value): quantities by market segment and nation, and brand."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.concat_ws("/", "c_mktsegment", "n_name").alias("target"), F.col("p_brand").alias("context")).agg(F.sum("l_quantity").cast("double").alias("value"))


PAIRS = """pairs AS (SELECT c_mktsegment || '/' || n_name AS target, p_brand AS context, CAST(SUM(l_quantity) AS DOUBLE) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(left, right): pairs of targets of one segment."""
    t = pairs(spark, sf_dir).select("target").distinct()
    a, b = t.select(F.col("target").alias("left")), t.select(F.col("target").alias("right"))
    return a.join(b, (F.substring_index("left", "/", 1) == F.substring_index("right", "/", 1)) & (F.col("left") < F.col("right")))


WORD_PAIRS = """words AS (SELECT DISTINCT target FROM pairs),
wp AS (SELECT a.target AS l, b.target AS r FROM words a JOIN words b ON split_part(a.target, '/', 1) = split_part(b.target, '/', 1) AND a.target < b.target)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(compound, const, subject, rating): returned line numbers by brand, type and supplier."""
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("compound"), F.col("p_type").alias("const"), F.col("l_suppkey").alias("subject")).agg(F.min("l_linenumber").cast("double").alias("rating"))


RATINGS = """ratings AS (SELECT p_brand AS compound, p_type AS const, l_suppkey AS subject, CAST(MIN(l_linenumber) AS DOUBLE) AS rating
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2, 3)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("feature")).agg(F.count("*").cast("double").alias("total"))


FEATURES = "features AS (SELECT p_name AS feature, CAST(COUNT(*) AS DOUBLE) AS total FROM part GROUP BY 1)"


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("out1"), F.col("toxic").alias("out2"))


def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cue, response, count): types and brands of parts."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("cue"), F.col("p_brand").alias("response")).agg(F.count("*").alias("count"))


NORMS = "norms AS (SELECT p_type AS cue, p_brand AS response, COUNT(*) AS count FROM part GROUP BY 1, 2)"


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, topic, p): a distribution over ten topics for each brand, from hashed cells."""
    words = table(spark, sf_dir, "part").select(F.col("p_brand").alias("word")).distinct()
    cells = words.select("word", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("topic")).withColumn("u", 0.05 + uniform(7, "word", "topic"))
    return cells.join(cells.groupBy("word").agg(F.sum("u").alias("s")), "word").select("word", "topic", (F.col("u") / F.col("s")).alias("p"))


def u_sql(seed: str, *keys: str) -> str:
    """The hashed uniform number in SQL."""
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8)) AS BIGINT) / 4294967296.0)"


TOPICS = f"""cells AS (SELECT p_brand AS word, topic, 0.05 + {u_sql('7', 'p_brand', 'topic')} AS u FROM (SELECT DISTINCT p_brand FROM part), (SELECT UNNEST(range(10)) AS topic)),
topics AS (SELECT word, topic, u / SUM(u) OVER (PARTITION BY word) AS p FROM cells)"""


def brand_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "part").select(F.col("p_brand").alias("left")).distinct()
    return w.join(w.select(F.col("left").alias("right")), F.col("left") < F.col("right"))


BRAND_PAIRS = "bp AS (SELECT a.w AS l, b.w AS r FROM (SELECT DISTINCT p_brand AS w FROM part) a JOIN (SELECT DISTINCT p_brand AS w FROM part) b ON a.w < b.w)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, word, feat, feat2, count) from orders and their lines; every third line has no feature."""
    feat = F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(F.col("l_suppkey") % 20 + 1)
    feat2 = F.when((F.col("l_linenumber") % 3 == 0) | (F.col("l_linenumber") % 2 == 0), 0).otherwise(F.col("l_partkey") % 5 + 1)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 50 + 1).cast("int").alias("word"), feat.cast("int").alias("feat"), feat2.cast("int").alias("feat2"), F.col("l_quantity").cast("int").alias("count"))


CORPUS = """corpus AS (SELECT l_orderkey AS doc, CAST(l_partkey % 50 + 1 AS INTEGER) AS word, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_suppkey % 20 + 1 END AS INTEGER) AS feat,
  CAST(CASE WHEN l_linenumber % 3 = 0 OR l_linenumber % 2 = 0 THEN 0 ELSE l_partkey % 5 + 1 END AS INTEGER) AS feat2, CAST(l_quantity AS INTEGER) AS count FROM lineitem)"""


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    item = F.concat_ws(":", F.concat_ws(",", "word", F.when(F.col("feat") > 0, F.col("feat")), F.when(F.col("feat2") > 0, F.col("feat2"))), "count")
    return rows.groupBy("doc").agg(F.array_join(F.sort_array(F.collect_list(item)), " ").alias("value"))
