"""Multimodal corpora: one row a token type of a document, (doc, word, feat, feat2, count)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wordloom.functions.draws import heads
from wordloom.functions.scratch import stored
from wordloom.operators.ranks import running

TOKEN = r"^(\d+)(?:,(\d+))?(?:,(\d+))?:(\d+)$"


def parse(lines: DataFrame, doc: str = "doc", text: str = "value") -> DataFrame:
    """Lines of items w:c, w,f:c or w,f,f2:c as rows; a missing feature is 0.

    An item of another form raises an error when it is read.
    """
    items = lines.select(F.col(doc).cast("bigint").alias("doc"), F.explode(F.split(F.trim(text), " +")).alias("item")).filter("item <> ''")
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract("item", TOKEN, k), F.lit("")), F.lit("0")).cast("int")
    good = F.when(F.rlike("item", F.lit(TOKEN)), F.col("doc")).otherwise(F.raise_error(F.concat(F.lit("not a corpus item: "), "item")).cast("bigint"))
    return items.select(good.alias("doc"), part(1).alias("word"), part(2).alias("feat"), part(3).alias("feat2"), part(4).alias("count"))


def formatted(corpus: DataFrame) -> DataFrame:
    """(doc, value): the corpus as lines, the inverse of ``parse``."""
    item = F.concat(F.concat_ws(",", "word", F.when(F.col("feat") + F.col("feat2") > 0, F.col("feat")), F.when(F.col("feat2") > 0, F.col("feat2"))), F.lit(":"), "count")
    rows = corpus.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("word", "feat", "feat2", item.alias("item")))).alias("items"))
    return rows.select("doc", F.array_join(F.transform("items", lambda x: x["item"]), " ").alias("value"))


def document_lengths(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("doc").agg(F.sum("count").alias("length"), F.count("*").alias("items"))


def merged(corpus: DataFrame) -> DataFrame:
    """Repeated cells of a document added up."""
    return corpus.groupBy("doc", "word", "feat", "feat2").agg(F.sum("count").cast("int").alias("count"))


def multimodal_only(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with a feature, words numbered anew from 1 by first appearance, and (word, old) for the numbers.

    Documents without such items leave.  First appearance is the least
    document, then the least old number in it.
    """
    kept = corpus.filter("feat > 0")
    first = kept.groupBy("word").agg(F.min("doc").alias("first"))
    numbers = running(first, ["first", "word"], name="_k").select((F.col("_k") + 1).cast("int").alias("new"), F.col("word").alias("old"))
    renamed = kept.join(numbers, kept["word"] == numbers["old"]).select("doc", F.col("new").alias("word"), "feat", "feat2", "count")
    return renamed, numbers.select(F.col("new").alias("word"), "old")


def features_only(corpus: DataFrame) -> DataFrame:
    """(doc, value): lines of f:c, empty for a document without features."""
    features = corpus.filter("feat > 0").groupBy("doc", "feat").agg(F.sum("count").alias("count"))
    lines = features.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("feat", "count"))).alias("items"))
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["feat"].cast("string"), x["count"].cast("string"))), " ")
    return corpus.select("doc").distinct().join(lines.select("doc", text.alias("value")), "doc", "left").select("doc", F.coalesce("value", F.lit("")).alias("value"))


def descending_cdf(features: DataFrame) -> DataFrame:
    """(word, feat, low, high): cumulative shares of a word's features, the likeliest first; numbers from 1.

    ``features``: (word, feat, p).  The last share ends at 1.
    """
    order = W.partitionBy("word").orderBy(F.col("p").desc(), "feat")
    total = F.sum("p").over(W.partitionBy("word"))
    high = F.sum("p").over(order.rowsBetween(W.unboundedPreceding, 0)) / total
    last = F.row_number().over(order) == F.count("*").over(W.partitionBy("word"))
    out = features.filter("p > 0").select("word", (F.col("feat") + 1).alias("feat"), (high - F.col("p") / total).alias("low"), F.when(last, F.lit(1.0)).otherwise(high).alias("high"))
    return out


def inject_features(corpus: DataFrame, cdf: DataFrame, seed: int = 42, draws: int = 1 << 20, shares: int = 10_000) -> DataFrame:
    """Each count of a word with a feature distribution becomes so many draws; equal draws are counted.

    Words without one stay as they are.  Corpus and ``cdf`` meet in groups of
    about ``draws`` draws and ``shares`` rows of the ``cdf``, which hold all rows
    of a document and word, so draws are counted where they are made and only
    their counts leave.
    """
    kind = {f.name: f.dataType.simpleString() for f in corpus.schema}
    feat = "bigint" if "bigint" in (kind["feat"], cdf.schema["feat"].dataType.simpleString()) else "int"
    corpus = stored(corpus.select("doc", "word", F.col("feat").cast(feat).alias("feat"), "feat2", "count"))
    cdf = stored(cdf.filter("word IS NOT NULL").select("word", F.col("feat").cast(feat).alias("feat"), "low", "high"))
    total = corpus.agg(F.coalesce(F.sum(F.greatest(F.col("count").cast("bigint"), F.lit(1))), F.lit(0))).first()[0]
    blocks = max(1, -(-cdf.count() // shares))
    parts = max(1, -(-total // (draws * blocks)))
    block = F.pmod(F.xxhash64("word"), F.lit(blocks).cast("bigint")).alias("_block")
    left = corpus.select(F.pmod(F.xxhash64("doc"), F.lit(parts).cast("bigint")).alias("_part"), block, "*")
    right = cdf.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("_part"), block, "*")
    schema = f"doc {kind['doc']}, word {kind['word']}, feat {feat}, feat2 {kind['feat2']}, count {kind['count']}"
    made = lambda rows, shares: _drawn(rows, shares, seed)
    return left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(made, schema)


def _drawn(rows: pa.Table, shares: pa.Table, seed: int, chunk: int = 1 << 14) -> pa.Table:
    """(doc, word, feat, feat2, count) of some rows of a corpus and the ``descending_cdf`` of their words."""
    names = ["doc", "word", "feat", "feat2", "count"]
    listed = shares.column("word").combine_chunks().dictionary_encode()
    word = pc.index_in(rows.column("word").combine_chunks(), value_set=listed.dictionary, skip_nulls=True)
    has = word.is_valid()
    plain, rows, word = rows.filter(pc.invert(has)).select(names), rows.filter(has), np.asarray(word.filter(has).cast(pa.int64()))
    # an interval holds k / 2**32 where its ends, times 2**32 and rounded up, hold k
    ends = lambda name: np.ceil(np.asarray(shares.column(name)) * 2.0**32).astype(np.int64)
    of, low, high = np.asarray(listed.indices).astype(np.int64), ends("low"), ends("high")
    order = np.lexsort([low, high, of])
    of, low, high, feats = of[order], low[order], high[order], np.asarray(shares.column("feat"))[order]
    stops, first = (of << 33) + high, np.searchsorted(of, np.arange(len(listed.dictionary)))
    most = int(np.bincount(of).max(initial=0))

    # rows of one document and word follow each other
    doc = np.asarray(rows.column("doc").combine_chunks().dictionary_encode(null_encoding="encode").indices).astype(np.int64)
    _, pair = np.unique(doc * (len(listed.dictionary) + 1) + word, return_inverse=True)
    order = np.argsort(pair, kind="stable")
    rows, word, pair = rows.take(pa.array(order)), word[order], pair[order]
    times = np.maximum(np.asarray(rows.column("count").fill_null(0)).astype(np.int64), 0)
    prefixes = np.array(["|".join(str(x) for x in (seed, d, w) if x is not None).encode() + b"|" for d, w in zip(rows.column("doc").to_pylist(), rows.column("word").to_pylist(), strict=True)], "S")
    until = np.cumsum(times)
    found = []
    for start in range(0, int(until[-1]) if len(until) else 0, chunk):
        ids = np.arange(start, min(start + chunk, int(until[-1])))
        row = np.searchsorted(until, ids, "right")
        least = int(row[0])
        k = heads(prefixes[least : int(row[-1]) + 1], row - least, ids - (until - times)[row] + 1)
        at = np.searchsorted(stops, (word[row] << 33) + k, "right")
        while True:  # ends that were rounded may let two intervals hold a draw, or none
            held = np.minimum(at, len(of) - 1)
            hit = (at < len(of)) & (of[held] == word[row]) & (low[held] <= k)
            if not hit.any():
                break
            row, at, k = row[hit], at[hit], k[hit]
            base = int(pair[row[0]])
            keys = (pair[row] - base) * most + at - first[word[row]]
            if (int(pair[row[-1]]) - base + 1) * most <= 8 * chunk:
                n = np.bincount(keys)
                keys = np.flatnonzero(n)
                n = n[keys]
            else:
                keys, n = np.unique(keys, return_counts=True)
            found.append((keys + base * most, n))
            at = at + 1
    if not found:
        return plain
    keys, n = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(keys, kind="stable")  # a pair of a document and word may lie in two chunks
    keys, n = keys[order], n[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, n = keys[begins], np.add.reduceat(n, begins)
    owner = np.searchsorted(pair, keys // most)
    own = rows.select(["doc", "word"]).take(pa.array(owner))
    own = own.append_column("feat", pa.array(feats[first[word[owner]] + keys % most], plain.schema.field("feat").type))
    own = own.append_column("feat2", pa.array(np.zeros(len(n), np.int64)).cast(plain.schema.field("feat2").type)).append_column("count", pa.array(n).cast(plain.schema.field("count").type))
    return pa.concat_tables([own.cast(plain.schema), plain])
