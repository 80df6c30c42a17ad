"""Readers of the text formats of word spaces, norms, ratings and corpora.

Compression follows from file names (.gz, .bz2).  All schemas are stated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.columns import download_name, word_of
from wordloom.operators import ratings as R


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) from lines, or from words parted by white space."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("word")).filter("word <> ''")


def read_space(spark: SparkSession, *paths: str, skip_first: bool = False) -> DataFrame:
    """(target, context, value) from tab-separated files, whose first lines can be skipped; blank lines and zeros leave."""
    rows = spark.read.schema("target string, context string, value double").option("sep", "\t").option("quote", "").option("header", skip_first).option("enforceSchema", True).csv(list(paths))
    return rows.filter("target IS NOT NULL AND value <> 0")


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) from lines word<tab>v v v."""
    parts = F.split("value", "\t")
    return spark.read.text(path).filter("trim(value) <> ''").select(parts[0].alias("word"), F.split(F.trim(parts[1]), " +").cast("array<double>").alias("vector"))


def read_ratings(spark: SparkSession, *paths: str) -> DataFrame:
    """Long ratings of wide files with a header each, added up."""
    tables = [R.long_form(spark.read.option("header", True).csv(p)) for p in paths]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("workerId string, worktime string, approval string, compound string, judgement int").csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) from lines of two tab-separated fields; others leave."""
    parts = F.split("value", "\t")
    return spark.read.text(path).filter(F.size(parts) == 2).select(parts[0].cast("int").alias("id"), parts[1].alias("label"))


def read_associations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cue string, response string, count bigint").option("sep", "\t").csv(path)


def read_raw_associations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, flag string, responses string").option("sep", "\t").csv(path)


def read_ranked_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("left string, right string, sim double, rank double, pct double").option("sep", "\t").csv(path)


def read_weighted_space(spark: SparkSession, path: str) -> DataFrame:
    """(target, context, value): frequency times the given pointwise information."""
    rows = spark.read.schema("target string, dim string, freq double, lmi double, pmi double").option("sep", "\t").csv(path)
    return rows.select("target", F.col("dim").alias("context"), (F.col("freq") * F.col("pmi")).alias("value"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("left string, right string").option("sep", "\t").csv(path)


def read_feature_norms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("target string, feature string, cnt bigint").option("sep", "\t").csv(path)


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, value): the lines of one file, numbered from 0 in order.

    Numbers come from the counts of lines of each partition (one row each), so
    no line is sorted or sent.
    """
    rows = spark.read.text(path).select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("k"))
    before, offsets = 0, [(-1, 0)]
    for r in sorted(rows.groupBy("part").count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    table = spark.createDataFrame(offsets, "part int, first bigint")
    return rows.join(F.broadcast(table), "part").select((F.col("first") + F.col("k")).alias("doc"), "value")


def read_human_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(left, right, similarity) of tables with translated words and human means."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    return rows.select(F.col("`Translation Word 1`").alias("left"), F.col("`Translation Word 2`").alias("right"), F.col("`Human (mean)`").cast("double").alias("similarity"))


def tagged_pairs(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Pairs with each word in the first tagged form that the vocabulary (label) has; pairs without one leave."""
    from wordloom.operators.topics import resolve_tags

    none = F.lit(None).cast("string").alias("pos")
    words = pairs.select(F.explode(F.array("left", "right")).alias("word"), none).distinct()
    found = resolve_tags(words, vocabulary).select("word", "label")
    left, right = found.toDF("left", "_l"), found.toDF("right", "_r")
    return pairs.join(left, "left").join(right, "right").select(F.col("_l").alias("left"), F.col("_r").alias("right"), *(c for c in pairs.columns if c not in ("left", "right")))


def read_gold_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pos, left, right, left_pos, right_pos, similarity) of rows x_A_B<tab>w1 w2<tab>similarity, entities decoded."""
    from wordloom.functions.columns import decode_entities

    rows = spark.read.schema("pos string, pair string, similarity double").option("sep", "\t").csv(path)
    words, tags = F.split(decode_entities(F.col("pair")), " "), F.split("pos", "_")
    return rows.select("pos", words[0].alias("left"), words[1].alias("right"), tags[1].alias("left_pos"), tags[2].alias("right_pos"), "similarity")


def read_compound_gold(spark: SparkSession, path: str) -> DataFrame:
    """(left, right, similarity) of compounds and their constituents, tagged as nouns; self-pairs leave."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path).filter("const <> compound")
    return rows.select(F.concat("const", F.lit("/NN")).alias("left"), F.concat("compound", F.lit("/NN")).alias("right"), F.col("mean").cast("double").alias("similarity"))


#: Files of the evaluation tables, by table and part.
EVAL_FILES = {
    "discotrain": "disco.train.tsv", "discovalid": "disco.valid.tsv", "discotest": "disco.test.tsv",
    "comp": "comp.tsv", "comphead": "comp.head.tsv", "compmod": "comp.mod.tsv", "schm280": "schm280.tsv",
}
#: What is read for a name: several parts are added up; trainvalid has no row of the test part (Q25).
EVAL_PARTS = {"disco": ("discotrain", "discovalid", "discotest"), "discotrainvalid": ("discotrain", "discovalid")}


def read_eval_table(spark: SparkSession, folder: str, vocabulary: DataFrame, method: str, files: dict[str, str] | None = None) -> DataFrame:
    """(left, right, similarity) of an evaluation table by its name, words tagged.

    disco, its parts discotrain, discovalid, discotest and discotrainvalid, and
    schm280 take the tagged forms that ``vocabulary`` (label) has, and leave out
    pairs without one; comp, comphead and compmod are nouns.
    """
    files = EVAL_FILES | (files or {})
    parts = EVAL_PARTS.get(method, (method,))
    if any(p not in files for p in parts):
        raise ValueError(f"table {method!r} is not supported; there are {', '.join(sorted({*files, *EVAL_PARTS}))}")
    tables = [f"{folder}/{files[p]}" for p in parts]
    if method.startswith("comp"):
        return read_compound_gold(spark, tables[0])
    if method == "schm280":
        return tagged_pairs(read_human_pairs(spark, tables[0]), vocabulary)
    from wordloom.operators.topics import resolve_tags

    rows = read_gold_pairs(spark, tables[0])
    for t in tables[1:]:
        rows = rows.unionByName(read_gold_pairs(spark, t))
    for side in ("left", "right"):
        words = rows.select(F.col(side).alias("word"), F.col(f"{side}_pos").alias("pos")).distinct()
        found = resolve_tags(words, vocabulary).toDF(side, f"{side}_pos", f"_{side}")
        rows = rows.join(found, [side, f"{side}_pos"])
    return rows.select(F.col("_left").alias("left"), F.col("_right").alias("right"), "similarity")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word): the second fields of lines, parts of speech off, each word once."""
    word = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(word) >= 2).select(word_of(word[1]).alias("word")).distinct()


def read_downloads(spark: SparkSession, path: str, present: DataFrame | None = None) -> DataFrame:
    """(keyword, url, name) of lists of downloads; those whose file name is in ``present`` (name) leave."""
    rows = spark.read.schema("keyword string, url string").option("sep", "\t").csv(path).withColumn("name", download_name(F.col("url")))
    return rows if present is None else rows.join(present.select("name").distinct(), "name", "left_anti").select("keyword", "url", "name")


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, xmin, ymin, xmax, ymax) of the objects in annotation files, one file a row."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    fields = ("name", "bndbox/xmin", "bndbox/ymin", "bndbox/xmax", "bndbox/ymax")
    lists = [F.xpath("value", F.lit(f"/annotation/object/{f}/text()")).alias(f.split("/")[-1]) for f in fields]
    rows = files.select("path", F.explode(F.arrays_zip(*lists)).alias("o"))
    return rows.select("path", "o.name", *(F.col(f"o.{c}").cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


def read_image_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, content): the files in tar archives; unreadable archives give no rows."""
    import io
    import tarfile

    import pandas as pd

    def members(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        rows += [(name, m.name, tar.extractfile(m).read()) for m in tar if m.isfile()]
                except tarfile.TarError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "path string, member string, content binary")
