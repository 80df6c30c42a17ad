"""Association norms and feature norms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wordloom.functions.columns import divide, word_of
from wordloom.functions.scratch import stored
from wordloom.operators.similarity import cosine_block
from wordloom.operators.stats import interval_at, interval_of, midrank, percentile_rank, weighted_summary


def count_associations(raw: DataFrame) -> DataFrame:
    """(cue, response, count) from rows (word, flag, responses), responses joined by commas."""
    each = raw.select(F.col("word").alias("cue"), F.explode(F.split("responses", ",")).alias("response")).withColumn("response", F.trim("response"))
    return each.filter("response <> ''").groupBy("cue", "response").agg(F.count("*").alias("count"))


def usable_associations(norms: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Norms without cues as their own response and, given a vocabulary (word), without unknown words."""
    out = norms.filter("cue <> response")
    if vocabulary is not None:
        known = vocabulary.select("word").distinct()
        out = out.join(known.withColumnRenamed("word", "cue"), "cue", "left_semi").join(known.withColumnRenamed("word", "response"), "response", "left_semi")
    return out.select("cue", "response", "count")


def dropped_counts(norms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row: associations in all, of a cue with itself, with an unknown cue or response."""
    known = vocabulary.select(F.col("word").alias("cue"), F.lit(True).alias("has_cue")).distinct()
    marked = norms.join(known, "cue", "left").join(known.select(F.col("cue").alias("response"), F.col("has_cue").alias("has_response")), "response", "left")
    return marked.agg(F.count("*").alias("n"), F.count_if(F.col("cue") == F.col("response")).alias("own"), F.count_if(F.col("has_cue").isNull()).alias("unknown_cue"), F.count_if(F.col("has_response").isNull()).alias("unknown_response"))


def response_totals(norms: DataFrame) -> DataFrame:
    return norms.groupBy("response").agg(F.sum("count").alias("total"))


def best_hits(ranked: DataFrame, norms: DataFrame) -> DataFrame:
    """(cue, response, count, pct): norms with the best percentile of their ranked pairs (left, right, pct).

    Keys are compared without parts of speech; percentiles of 0 or less count as
    not found (Q44).
    """
    pairs = ranked.filter("pct > 0").select(word_of(F.col("left")).alias("cue"), word_of(F.col("right")).alias("response"), "pct")
    return pairs.join(norms, ["cue", "response"]).groupBy("cue", "response").agg(F.max("pct").alias("pct"), F.max("count").alias("count")).select("cue", "response", "count", "pct")


def ranked_norms(ranked: DataFrame, norms: DataFrame) -> DataFrame:
    """One row: weighted percentiles of the norms found among ranked pairs, and the mean that counts missing ones as 0."""
    hits = best_hits(ranked, norms)
    summary = weighted_summary(hits, "pct", "count")
    total = norms.agg(F.sum("count").alias("all_counts"))
    found = hits.agg(F.sum(F.col("pct") * F.col("count")).alias("found"))
    return summary.crossJoin(total).crossJoin(found).withColumn("coverage_mean", divide(F.col("found"), F.col("all_counts").cast("double"))).drop("found", "all_counts")


def norm_percentiles(space: DataFrame, norms: DataFrame, suffix: str = "/NN") -> DataFrame:
    """(cue, response, count, pct): percentile of a response's cosine with its cue among all words.

    ``space``: (word, vector), words with parts of speech.  A cue is looked up
    with ``suffix``; a response stands for all its parts of speech, the best counts.
    """
    cues = norms.select("cue").distinct().withColumn("word", F.concat("cue", F.lit(suffix)))
    queries = space.join(cues, "word", "left_semi")
    sims = cosine_block(queries, space).filter("query <> word")
    ranks = percentile_rank(sims, "cosine", "query").select(word_of(F.col("query")).alias("cue"), word_of(F.col("word")).alias("response"), "pct")
    return ranks.join(norms, ["cue", "response"]).groupBy("cue", "response").agg(F.max("count").alias("count"), F.max("pct").alias("pct"))


def sparse_percentiles(space: DataFrame, cues: DataFrame, suffix: str = "/NN") -> DataFrame:
    """(cue, word, pct): for each cue (word), the percentile of every word's cosine with it among all words, its own too.

    ``space``: sparse cells (target, context, value).  A cue is looked up with
    ``suffix``.  Only words that share a context with a cue are listed and
    ranked; all others have a cosine of 0 and the percentile of that, which the
    row with a null word holds.
    """
    space = stored(space.groupBy("target", "context").agg(F.sum("value").alias("value")).filter("value <> 0"))
    length = space.groupBy("target").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    own = space.join(cues.select("word").distinct().select(F.col("word").alias("cue"), F.concat("word", F.lit(suffix)).alias("target")), "target")
    dots = own.select("cue", "context", F.col("value").alias("x")).join(space, "context").groupBy("cue", "target").agg(F.sum(F.col("x") * F.col("value")).alias("dot"))
    sides = own.select("cue", "target").distinct().join(length, "target").select("cue", F.col("length").alias("_l"))
    sims = dots.join(sides, "cue").join(length, "target").select("cue", F.col("target").alias("word"), F.round(F.col("dot") / (F.col("_l") * F.col("length")), 12).alias("cosine"))
    sims = stored(sims.filter("cosine <> 0"))
    words = length.agg(F.count("*").alias("_all"))
    sizes = sides.select("cue").join(sims.groupBy("cue").agg(F.count("*").alias("_k"), F.count_if(F.col("cosine") < 0).alias("_less")), "cue", "left").na.fill(0).crossJoin(F.broadcast(words))
    ranked = sims.withColumn("_r", midrank("cosine", "cue")).join(sizes, "cue")
    place = F.col("_r") + F.when(F.col("cosine") > 0, F.col("_all") - F.col("_k")).otherwise(0)
    zero = F.ceil(F.col("_less") + (F.col("_all") - F.col("_k") + 1) / F.lit(2.0)) / F.col("_all").cast("double")
    rest = sizes.select("cue", F.lit(None).cast("string").alias("word"), zero.alias("pct"))
    return ranked.select("cue", "word", (F.ceil(place) / F.col("_all").cast("double")).alias("pct")).unionByName(rest)


def association_pipeline(space: DataFrame, norms: DataFrame, suffix: str = "/NN") -> DataFrame:
    """One row: how high a weighted space ranks the responses of association norms.

    ``space``: (target, context, value), targets with parts of speech; ``norms``:
    (cue, response, count).  Cues that are their own response, and those or
    responses that the space lacks, are counted (own, unknown) and left out.  A
    response stands for all its parts of speech, of which the best counts;
    ``higher`` counts the others.  Mean, deviation and percentiles weigh hits by
    ``count``; low and high are the Bayesian interval of the mean at 0.95, and low50 and high50 at 0.5.
    """
    space, norms = stored(space), stored(norms)  # read many times, made once
    targets = space.select("target").distinct()
    forms = targets.select("target", word_of(F.col("target")).alias("response"))
    known = forms.select(F.col("response").alias("word")).distinct()
    usable = stored(usable_associations(norms, known))
    cued = usable.join(targets.filter(F.endswith("target", F.lit(suffix))).select(word_of(F.col("target")).alias("cue")), "cue", "left_semi")
    ranks = stored(sparse_percentiles(space, cued.select(F.col("cue").alias("word")), suffix))
    options = cued.join(forms, "response").join(ranks.filter("word IS NOT NULL").withColumnRenamed("word", "target"), ["cue", "target"], "left")
    options = options.join(ranks.filter("word IS NULL").select("cue", F.col("pct").alias("_zero")), "cue")
    hits = stored(options.groupBy("cue", "response").agg(F.max("count").alias("count"), F.max(F.coalesce("pct", "_zero")).alias("pct"), F.count("*").alias("_forms")))
    out = weighted_summary(hits, "pct", "count")
    counts = norms.agg(F.count_if(F.col("cue") == F.col("response")).alias("own"), F.count("*").alias("_rows"))
    more = hits.agg(F.sum(F.col("_forms") - 1).alias("higher"))
    out = out.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(usable.agg(F.count("*").alias("_usable")))).crossJoin(F.broadcast(more))
    spread = F.col("std") * F.col("std") * F.when(F.col("n") > 1000, F.lit(1.0)).otherwise(F.col("n") / (F.col("n") - 1).cast("double"))
    out = out.withColumn("_i", interval_of("mean", spread, "n")).withColumn("_h", interval_at(0.5)("mean", spread, "n"))
    drop = ["_rows", "_usable", "_i", "_h"]
    named = {"unknown": F.col("_rows") - F.col("own") - F.col("_usable"), "low": F.col("_i.low"), "high": F.col("_i.high"), "low50": F.col("_h.low"), "high50": F.col("_h.high")}
    return out.withColumns(named).drop(*drop)


def feature_totals(norms: DataFrame) -> DataFrame:
    return norms.groupBy("feature").agg(F.sum("cnt").alias("total"))


def suggestions(features: DataFrame, most: int = 5) -> DataFrame:
    """(feature, other, distance, weight, rank): likely duplicates, ln(total of the other) / edit distance.

    ``features``: (feature, total), each feature once, totals above 0.  Ties go to the lesser name.
    """
    best = W.partitionBy("feature").orderBy(F.col("weight").desc(), "other")
    found = suggestion_pairs(features, most).withColumn("rank", F.dense_rank().over(best)).filter(F.col("rank") <= most)
    return found.select("feature", "other", "distance", "weight", "rank").distinct()


def suggestion_pairs(features: DataFrame, most: int = 5, heads: int = 8, part: int = 4096) -> DataFrame:
    """(feature, other, distance, weight): pairs among which are the ``most`` of largest weight of every feature; some come twice.

    The edit distance is at least 1, the difference in length, and the number of
    letters that one of the two lacks, which bounds the weight.  Each feature
    first meets the others of largest total of about its own length; its last
    place among those is a weight to beat.  Others stand in bands of one length
    and one power of two of the total; only bands whose bound reaches that
    weight are then met, in parts of bounded size, and only pairs whose letters
    allow it are compared.
    """
    letters = F.aggregate(F.split("feature", ""), F.lit(0).cast("bigint"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.ascii(c), F.lit(64)))))
    known = stored(features.select(F.col("feature").alias("other"), "total", F.length("feature").alias("length"), F.floor(F.log2("total")).cast("int").alias("class"), F.ln("total").alias("log"), letters.alias("letters")))
    own = known.select(F.col("other").alias("feature"), F.col("length").alias("own"), F.col("letters").alias("mask"))

    def weighed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter("feature <> other").withColumn("distance", F.levenshtein("feature", "other").cast("double"))
        return pairs.select("feature", "other", "distance", divide(F.col("log"), F.col("distance")).alias("weight"))

    place = F.row_number().over(W.partitionBy("length").orderBy(F.col("log").desc(), "other"))
    tops = known.withColumn("_k", place).filter(F.col("_k") <= heads).select("length", "other", "log")
    largest = known.orderBy(F.col("log").desc(), "other").limit(most + 1).agg(F.collect_list(F.struct("other", "log")).alias("_largest"))
    near = own.select("feature", F.explode(F.sequence(F.col("own") - 2, F.col("own") + 2)).alias("length")).join(tops, "length").select("feature", "other", "log")
    wide = own.crossJoin(F.broadcast(largest)).select("feature", F.inline("_largest"))
    first = stored(weighed(near.unionByName(wide).distinct()))
    kept = F.row_number().over(W.partitionBy("feature").orderBy(F.col("weight").desc(), "other"))
    beaten = first.withColumn("_k", kept).filter(F.col("_k") == most).select("feature", F.col("weight").alias("_beat"))

    # a little slack, as bounds are worked out in another order than weights
    able = lambda log, least: F.col("_beat").isNull() | (F.when(log > 0, log / least).otherwise(0.0) >= F.col("_beat") - 1e-9)
    apart = lambda length: F.greatest(F.abs(length - F.col("own")), F.lit(1))
    sizes = known.groupBy("length", "class").agg(F.max("log").alias("log"), F.ceil(F.count("*") / F.lit(part)).cast("int").alias("parts"))
    bands = sizes.agg(F.collect_list(F.struct("length", "class", "log", "parts")).alias("_bands"))  # lengths times powers of two
    met = own.join(beaten, "feature", "left").crossJoin(F.broadcast(bands)).select("feature", "own", "mask", "_beat", F.inline(F.filter("_bands", lambda b: able(b["log"], apart(b["length"]))))).drop("log")
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    held = known.join(F.broadcast(sizes.select("length", "class", "parts")), ["length", "class"]).withColumn("part", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int")).drop("parts", "total")
    lacks = F.greatest(F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not("letters"))), F.bit_count(F.col("letters").bitwiseAND(F.bitwise_not("mask"))))
    rest = weighed(met.join(held, ["length", "class", "part"]).filter(able(F.col("log"), F.greatest(apart(F.col("length")), lacks))).select("feature", "other", "log"))
    return first.unionByName(rest)


# Groups of feature prefixes that say the same, the first one is canonical.
PREFIX_GROUPS = [("ist", "es ist", "sind"), ("hat", "es hat", "haben"), ("gibt", "es gibt"), ("besteht", "es besteht")]


def prefix_variants(norms: DataFrame, groups: list[tuple[str, ...]] | None = None) -> DataFrame:
    """(canonical, variant, stem, cues): stems seen under two or more prefixes of a group, with the cues of each.

    Rows of variants other than the canonical one are those to remap.
    """
    table = [(g[0], v) for g in groups or PREFIX_GROUPS for v in g]
    variants = F.array(*(F.struct(F.lit(c).alias("canonical"), F.lit(v).alias("variant")) for c, v in table))
    rows = norms.select("cue", "resp", F.explode(variants).alias("g")).select("cue", "resp", "g.*")
    rows = rows.filter(F.startswith("resp", F.concat("variant", F.lit(" ")))).withColumn("stem", F.substring("resp", F.length("variant") + 2, F.length("resp")))
    seen = rows.groupBy("canonical", "stem").agg(F.countDistinct("variant").alias("n")).filter("n >= 2")
    return rows.join(seen, ["canonical", "stem"], "left_semi").groupBy("canonical", "variant", "stem").agg(F.sort_array(F.collect_set("cue")).alias("cues"))
