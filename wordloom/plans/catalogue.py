"""Queries over the driver's tables, each with DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.columns import pos_of, steps, uniform, word_of
from wordloom.functions.scratch import stored
from wordloom.operators import corpus as C
from wordloom.operators import cleanup, evaluation, factor, images, matches, noise
from wordloom.operators import norms as N
from wordloom.operators import ratings as R
from wordloom.operators import similarity as S
from wordloom.operators import space as P
from wordloom.operators import stats, topic_models, topics
from wordloom.plans import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded alike on both sides; -0 becomes 0."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def query(name: str, sql: str | None = None, keep: bool = False) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f if keep else (lambda spark, sf_dir: rounded(f(spark, sf_dir)))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


# --- spaces ---------------------------------------------------------------------------------------

_MASSES = "m AS (SELECT *, SUM(value) OVER (PARTITION BY target) AS r, SUM(value) OVER (PARTITION BY context) AS c, SUM(value) OVER () AS t FROM pairs)"
_PMI = "log2(value) + log2(t) - log2(r) - log2(c)"

for _name, _sql in {"pmi": _PMI, "lmi": f"value / t * ({_PMI})", "prob": "value / t", "neglogprob": "log2(t) - log2(value)", "norm1": "value / r"}.items():
    query(f"space_{_name}", f"WITH {X.PAIRS}, {_MASSES} SELECT target, context, {r6(_sql, 'value')} FROM m")(lambda s, d, m=_name: P.weight(X.pairs(s, d), m))

_PPMI = f"p AS (SELECT target, context, {_PMI} AS value FROM m), k AS (SELECT * FROM p WHERE value > 0)"


@query("space_ppmi_norm", f"WITH {X.PAIRS}, {_MASSES}, {_PPMI} SELECT target, context, {r6('value / SUM(value) OVER (PARTITION BY target)', 'value')} FROM k")
def space_ppmi_norm(s, d):
    return P.weight(X.pairs(s, d), "pmi", "positive", "norm1")


query("space_positive", f"WITH {X.PAIRS}, {_MASSES}, {_PPMI} SELECT target, context, {r6('value', 'value')} FROM k")(lambda s, d: P.weight(X.pairs(s, d), "pmi", "positive"))
query("space_clipped_lmi", f"WITH {X.PAIRS}, {_MASSES} SELECT target, context, {r6(f'greatest(value / t * ({_PMI}), 0)', 'value')} FROM m")(lambda s, d: P.clipped_lmi(X.pairs(s, d)))
query("space_norm2", f"WITH {X.PAIRS} SELECT target, context, {r6('value / sqrt(SUM(value * value) OVER (PARTITION BY target))', 'value')} FROM pairs")(lambda s, d: P.norm2(X.pairs(s, d)))
query("space_masses", f"WITH {X.PAIRS} SELECT 'total' AS kind, '' AS key, SUM(value) AS mass FROM pairs UNION ALL SELECT 'target', target, SUM(value) FROM pairs GROUP BY target UNION ALL SELECT 'context', context, SUM(value) FROM pairs GROUP BY context")(lambda s, d: P.masses(X.pairs(s, d)))

_TOP = "top AS (SELECT context FROM pairs GROUP BY context ORDER BY SUM(value) DESC, context LIMIT 10)"
query("space_keep_top", f"WITH {X.PAIRS}, {_TOP} SELECT target, context, value FROM pairs WHERE context IN (SELECT context FROM top)")(lambda s, d: P.weight(X.pairs(s, d), keep=10))
query("space_keep_by_name", f"WITH {X.PAIRS}, top AS (SELECT DISTINCT context FROM pairs ORDER BY context DESC LIMIT 10) SELECT target, context, value FROM pairs WHERE context IN (SELECT context FROM top)")(lambda s, d: P.weight(X.pairs(s, d), keep=10, keep_by="name"))
query("space_stopwords", f"WITH {X.PAIRS} SELECT target, context, value FROM pairs WHERE context NOT IN (SELECT p_brand FROM part WHERE p_brand LIKE '%1')")(lambda s, d: P.weight(X.pairs(s, d), stopwords=X.table(s, d, "part").filter("p_brand LIKE '%1'").select(F.col("p_brand").alias("context"))))
query("space_pos_strip", f"WITH {X.PAIRS} SELECT DISTINCT target, regexp_extract(target, '^(.*)/([^/]*)$', 1) AS word, regexp_extract(target, '^(.*)/([^/]*)$', 2) AS pos FROM pairs")(lambda s, d: X.pairs(s, d).select("target").distinct().select("target", word_of(F.col("target")).alias("word"), pos_of(F.col("target")).alias("pos")))
query("space_without_pos", f"WITH {X.PAIRS} SELECT split_part(target, '/', 1) AS target, context, SUM(value) AS value FROM pairs GROUP BY 1, 2")(lambda s, d: P.without_pos(X.pairs(s, d)))
query("space_whitelist", f"WITH {X.PAIRS} SELECT * FROM pairs WHERE split_part(target, '/', 1) IN (SELECT c_mktsegment FROM customer WHERE c_mktsegment LIKE '%U%')")(lambda s, d: P.keep_targets(X.pairs(s, d), X.table(s, d, "customer").filter("c_mktsegment LIKE '%U%'").select(F.col("c_mktsegment").alias("word")), without_pos=True))
query("space_frequent_contexts", f"WITH {X.PAIRS} SELECT context, COUNT(*) AS n FROM pairs WHERE value > 100 GROUP BY context HAVING COUNT(*) >= 2")(lambda s, d: P.frequent_contexts(X.pairs(s, d).filter("value > 100")))
query("space_context_numbers", f"WITH {X.PAIRS} SELECT context, CAST(row_number() OVER (ORDER BY context) - 1 AS INTEGER) AS number FROM pairs GROUP BY context HAVING COUNT(*) >= 2")(lambda s, d: P.context_numbers(X.pairs(s, d)))
_DENSE = "g AS (SELECT split_part(target, '/', 1) AS word, context, SUM(value) AS value FROM pairs GROUP BY 1, 2), names AS (SELECT context FROM pairs GROUP BY context HAVING COUNT(*) >= 2)"
query("space_dense_rows", f"WITH {X.PAIRS}, {_DENSE} SELECT w.word, n.pos AS at, COALESCE(g.value, 0) AS value FROM (SELECT DISTINCT word FROM g) w, (SELECT context, CAST(row_number() OVER (ORDER BY context) - 1 AS INTEGER) AS pos FROM names) n LEFT JOIN g ON g.word = w.word AND g.context = n.context")(lambda s, d: P.dense_rows(X.pairs(s, d)).select("word", F.posexplode("vector").alias("at", "value")))
query("space_stack", f"WITH {X.PAIRS} SELECT target, 'a:' || context AS context, value FROM pairs UNION ALL SELECT target, 'b:' || context, value FROM pairs WHERE value > 100")(lambda s, d: P.stack(a=X.pairs(s, d), b=X.pairs(s, d).filter("value > 100")))
query("space_context_shares", f"WITH {X.PAIRS} SELECT target, context, {r6('value / SUM(value) OVER (PARTITION BY context)', 'value')} FROM pairs")(lambda s, d: P.normalise_by(X.pairs(s, d), "context"))

# --- similarities ---------------------------------------------------------------------------------

_SIM = f"""WITH {X.PAIRS}, {X.WORD_PAIRS},
cell AS (SELECT l, r, c.context, COALESCE(a.value, 0) AS a, COALESCE(b.value, 0) AS b FROM wp CROSS JOIN (SELECT DISTINCT context FROM pairs) c
  LEFT JOIN pairs a ON a.target = l AND a.context = c.context LEFT JOIN pairs b ON b.target = r AND b.context = c.context)"""
_COS = "SUM(a * b) / (sqrt(SUM(a * a)) * sqrt(SUM(b * b)))"
for _name, _sql in {"cosine": _COS, "dot": "SUM(a * b)", "euclid": "sqrt(SUM((a - b) * (a - b)))", "normeuclid": f"sqrt(greatest(2 - 2 * {_COS}, 0))", "jaccard": "COUNT(*) FILTER (a <> 0 AND b <> 0) / COUNT(*) FILTER (a <> 0 OR b <> 0)"}.items():
    query(f"sim_{_name}", f'{_SIM} SELECT l AS "left", r AS "right", {r6(_sql, _name)} FROM cell GROUP BY l, r')(lambda s, d, m=_name: S.distances(X.pairs(s, d), X.word_pairs(s, d), m))
_RANK = "rank() OVER (PARTITION BY {g} ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0"


def rho_sql(x: str = "rx", y: str = "ry") -> str:
    return f"(COUNT(*) * SUM({x} * {y}) - SUM({x}) * SUM({y})) / nullif(sqrt(greatest((COUNT(*) * SUM({x} * {x}) - SUM({x}) * SUM({x})) * (COUNT(*) * SUM({y} * {y}) - SUM({y}) * SUM({y})), 0)), 0)"


def spearman_sql(source: str, x: str, y: str, group: str, more: str = "") -> str:
    """CTEs ending in rho(group, rho, n)."""
    key = group or "1"
    ranks = f"rk AS (SELECT {group + ', ' if group else ''}{_RANK.format(g=key, x=x)} AS rx, {_RANK.format(g=key, x=y)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"{ranks}, rho AS (SELECT {group + ', ' if group else ''}COALESCE({rho_sql()}, -1.0) AS rho, COUNT(*) AS n FROM rk {'GROUP BY ' + group if group else ''})"


query("sim_spearman", f'{_SIM}, {spearman_sql("cell", "a", "b", "l, r")} SELECT l AS "left", r AS "right", {r6("rho", "spearman")} FROM rho')(lambda s, d: S.spearman(X.pairs(s, d), X.word_pairs(s, d)))
_DIV = f"""WITH {X.TOPICS}, {X.BRAND_PAIRS},
j AS (SELECT l, r, a.p AS p, b.p AS q, (a.p + b.p) / 2 AS m FROM bp JOIN topics a ON a.word = l JOIN topics b ON b.word = r AND b.topic = a.topic)"""
query("sim_divergences", f'{_DIV} SELECT l AS "left", r AS "right", {r6("SUM(p * log2(p / q))", "kl")}, {r6("SUM(q * log2(q / p))", "kl_reversed")}, {r6("SUM(p * log2(p / m)) / 2 + SUM(q * log2(q / m)) / 2", "js")}, {r6("SUM(p * log2(p / q)) + SUM(q * log2(q / p))", "symkl")} FROM j GROUP BY l, r')(lambda s, d: S.divergences(X.topics(s, d), X.brand_pairs(s, d)))
_CON = f"""WITH {X.TOPICS}, {X.BRAND_PAIRS}, t AS (SELECT word, topic, p / SUM(p) OVER (PARTITION BY topic) AS wt, p / SUM(p) OVER (PARTITION BY word) AS tw FROM topics)"""
query("sim_conditional", f'{_CON} SELECT l AS "left", r AS "right", {r6("SUM(b.wt * a.tw)", "right_given_left")}, {r6("SUM(a.wt * b.tw)", "left_given_right")} FROM bp JOIN t a ON a.word = l JOIN t b ON b.word = r AND b.topic = a.topic GROUP BY l, r')(lambda s, d: S.conditional(X.topics(s, d), X.brand_pairs(s, d)))
_SEVEN = f"""{_CON}, gold AS (SELECT l, r, 1 + floor({X.u_sql("3", "l", "r")} * 7) AS gold FROM bp),
lm AS (SELECT word, topic, greatest(p / n * ln((p / s) / (s / n)), 0) AS v FROM (SELECT *, SUM(p) OVER (PARTITION BY topic) AS s, SUM(p) OVER () AS n FROM topics)),
j AS (SELECT l, r, gold, a.wt AS awt, b.wt AS bwt, a.tw AS p, b.tw AS q, (a.tw + b.tw) / 2 AS m, la.v AS x, lb.v AS y FROM gold JOIN t a ON a.word = l JOIN t b ON b.word = r AND b.topic = a.topic JOIN lm la ON la.word = l AND la.topic = a.topic JOIN lm lb ON lb.word = r AND lb.topic = a.topic),
w AS (SELECT l, r, gold, SUM(bwt * p) AS right_given_left, SUM(awt * q) AS left_given_right, SUM(p * log2(p / m)) / 2 + SUM(q * log2(q / m)) / 2 AS js, SUM(p * log2(p / q)) + SUM(q * log2(q / p)) AS symkl,
  SUM(p * log2(p / q)) AS kl, SUM(q * log2(q / p)) AS kl_reversed, SUM(x * y) / nullif(sqrt(SUM(x * x)) * sqrt(SUM(y * y)), 0) AS cosine_lmi FROM j GROUP BY ALL),
e AS ({" UNION ALL ".join(f"SELECT l, r, '{m}' AS measure, {sign} AS sign, gold, round({m}, 9) AS v FROM w" for m, sign in evaluation.MEASURES.items())}),
{spearman_sql("e", "gold", "v", "measure")},
acc AS (SELECT a.measure, COUNT(*) AS pairs, AVG(CASE WHEN (a.sign * a.v < a.sign * b.v) = (a.gold < b.gold) THEN 1.0 ELSE 0.0 END) AS accuracy, AVG(CASE WHEN a.gold < b.gold THEN 1.0 ELSE 0.0 END) AS baseline FROM e a JOIN e b ON a.measure = b.measure AND a.l || chr(9) || a.r < b.l || chr(9) || b.r AND abs(a.gold - b.gold) >= 1 GROUP BY 1)
SELECT measure, {r6("rho", "rho")}, n, pairs, {r6("accuracy", "accuracy")}, {r6("baseline", "baseline")} FROM rho JOIN acc USING (measure)"""


@query("model_against_gold", _SEVEN)
def model_against_gold(s, d):
    gold = X.brand_pairs(s, d).withColumn("similarity", 1 + F.floor(uniform("3", "left", "right") * 7))
    return evaluation.against_gold(X.topics(s, d).select("topic", F.col("word").alias("item"), "p"), gold).drop("p")


query("sim_missing_words", f"WITH {X.PAIRS}, {X.WORD_PAIRS}, small AS (SELECT * FROM pairs WHERE target LIKE '%A') SELECT DISTINCT target FROM (SELECT l AS target FROM wp UNION ALL SELECT r FROM wp) WHERE target NOT IN (SELECT target FROM small)")(lambda s, d: S.missing_words(X.pairs(s, d).filter("target LIKE '%A'"), X.word_pairs(s, d)))


def _vectors(s, d, other=False):
    return X.table(s, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("word"), F.col("embedding").cast("array<double>").alias("vector"), "vec_id", "label")


@query("vec_cosine_dense", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id", keep=True)
def vec_cosine_dense(s, d):
    return S.cosine_pairs(X.table(s, d, "embeddings").withColumnRenamed("embedding", "vector"), "vec_id", "label", digits=6)


@query("vec_one_to_all", "SELECT 'v' || a.vec_id AS query, 'v' || b.vec_id AS word, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0", keep=True)
def vec_one_to_all(s, d):
    v = X.table(s, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("word"), F.col("embedding").alias("vector"), "vec_id")
    return S.cosine_block(v.filter("vec_id % 50 = 0"), v, digits=6)


# --- ratings --------------------------------------------------------------------------------------

_AGG = f"WITH {X.RATINGS}, agg AS (SELECT compound, const, COUNT(*) AS n, AVG(rating) AS mean, median(rating) AS median, COALESCE(stddev_samp(rating), 0) AS stddev FROM ratings GROUP BY 1, 2)"
query("ratings_aggregate", f"{_AGG} SELECT compound, const, n, {r6('mean', 'mean')}, {r6('median', 'median')}, {r6('stddev', 'stddev')}, {r6('stddev * stddev', 'var')} FROM agg")(lambda s, d: R.aggregate(X.ratings(s, d)))
for _name, _sql in {"sum": "SUM(mean)", "prod": "product(mean)", "gmean": "sqrt(product(mean))", "hmean": "2 * product(mean) / SUM(mean)"}.items():
    query(f"ratings_combine_{_name}", f"{_AGG} SELECT compound, {r6(_sql, 'mean')} FROM agg GROUP BY compound")(lambda s, d, m=_name: R.combine(R.aggregate(X.ratings(s, d)), m))
_LOO = f"""WITH {X.RATINGS}, o AS (SELECT *, round((SUM(rating) OVER (PARTITION BY compound, const) - rating) / nullif(COUNT(*) OVER (PARTITION BY compound, const) - 1, 0), 9) AS others FROM ratings),
{spearman_sql('o', 'rating', 'others', 'subject')}"""
query("ratings_agreement", f"{_LOO} SELECT subject, {r6('rho', 'rho')}, n FROM rho")(lambda s, d: R.agreements(X.ratings(s, d)))
query("ratings_drop_low_rho", f"{_LOO} SELECT compound, const, subject, rating FROM ratings WHERE subject NOT IN (SELECT subject FROM rho WHERE rho < 0.02)")(lambda s, d: R.drop_deviant_subjects(X.ratings(s, d), 0.02))
query("ratings_drop_n", f"{_LOO} SELECT compound, const, subject, rating FROM ratings WHERE subject NOT IN (SELECT subject FROM rho ORDER BY rho, subject LIMIT 5)")(lambda s, d: R.drop_worst_subjects(X.ratings(s, d), 5))
query("ratings_drop_share", f"{_LOO} SELECT compound, const, subject, rating FROM ratings WHERE subject NOT IN (SELECT subject FROM (SELECT subject, row_number() OVER (ORDER BY rho, subject) AS k FROM rho) WHERE k <= ceil(0.1 * (SELECT COUNT(DISTINCT subject) FROM ratings)))")(lambda s, d: R.drop_worst_subjects(X.ratings(s, d), share=0.1))
# the bound in sums, as whole ratings make it exact: with stddev_samp a rating right at it came and went with the order of the rows
_Z = f"""WITH {X.RATINGS}, z AS (SELECT *, COUNT(*) OVER w AS n, SUM(rating) OVER w AS s, SUM(rating * rating) OVER w AS q FROM ratings WINDOW w AS (PARTITION BY compound, const)),
kept AS (SELECT compound, const, subject, rating FROM z WHERE n * q > s * s AND (n * rating - s) * (n * rating - s) * (n - 1) <= n * (n * q - s * s))"""
query("ratings_zscore", f"{_Z} SELECT * FROM kept")(lambda s, d: R.drop_deviant_ratings(X.ratings(s, d), 1.0))
query("ratings_retained", f"{_Z} SELECT COUNT(*) AS before, (SELECT COUNT(*) FROM kept) AS after, {r6('(SELECT COUNT(*) FROM kept) / COUNT(*)', 'retained')} FROM ratings")(lambda s, d: R.retained(X.ratings(s, d), R.drop_deviant_ratings(X.ratings(s, d), 1.0)))
query("ratings_rebin", f"WITH {X.RATINGS} SELECT compound, const, subject, CASE rating WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 2.0 WHEN 4 THEN 2.0 ELSE rating END AS rating FROM ratings")(lambda s, d: R.rebin(X.ratings(s, d), "1122").select(*R.COLUMNS))
query("ratings_fill", f"WITH {X.RATINGS} SELECT i.compound, i.const, s.subject, COALESCE(r.rating, 0) AS rating FROM (SELECT DISTINCT compound, const FROM ratings) i CROSS JOIN (SELECT DISTINCT subject FROM ratings) s LEFT JOIN ratings r USING (compound, const, subject)")(lambda s, d: R.fill(X.ratings(s, d), 0.0))
query("ratings_profile", f"WITH {X.RATINGS} SELECT subject, COUNT(*) AS n, MIN(rating) AS min, MAX(rating) AS max, {r6('quantile_cont(rating, 0.25)', 'q1')}, {r6('median(rating)', 'median')}, {r6('quantile_cont(rating, 0.75)', 'q3')}, {r6('AVG(rating)', 'mean')}, {r6('stddev_samp(rating)', 'stddev')}, {', '.join(f'COUNT(*) FILTER (rating = {k}) AS n{k}' for k in range(1, 8))} FROM ratings GROUP BY subject")(lambda s, d: R.profile(X.ratings(s, d)))
_BOTH = f"WITH {X.RATINGS}, b AS (SELECT x.subject AS l, y.subject AS r, x.rating AS a, y.rating AS b FROM ratings x JOIN ratings y USING (compound, const) WHERE x.subject < y.subject)"
query("ratings_pair_agreement", f'{_BOTH}, {spearman_sql("b", "a", "b", "l, r")}, e AS (SELECT l, r, COUNT(*) AS n, AVG(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS g FROM b GROUP BY l, r) SELECT e.l AS "left", e.r AS "right", e.n, {r6("g", "agreement")}, {r6("rho", "rho")} FROM e JOIN rho ON e.l = rho.l AND e.r = rho.r', keep=True)(lambda s, d: R.pair_agreement(X.ratings(s, d), digits=6))
query("ratings_rank_curve", f"""{_LOO}, w AS (SELECT subject, rho, subject % 4 = 0 AS bad FROM rho), c AS (SELECT subject, row_number() OVER (ORDER BY round(rho, 9), subject) AS k, SUM(CAST(bad AS INTEGER)) OVER (ORDER BY round(rho, 9), subject ROWS UNBOUNDED PRECEDING) AS hits, SUM(CAST(bad AS INTEGER)) OVER () AS b, COUNT(*) OVER () AS n FROM w)
SELECT subject, CAST(k AS INTEGER) AS k, CAST(hits AS BIGINT) AS hits, {r6('hits / k', 'precision')}, {r6('hits / nullif(b, 0)', 'recall')}, {r6('2 * (hits / k) * (hits / nullif(b, 0)) / nullif(hits / k + hits / nullif(b, 0), 0)', 'f')} FROM c WHERE k < n""")(lambda s, d: R.rank_curve(R.agreements(X.ratings(s, d)).select("subject", F.round("rho", 9).alias("rho"), (F.col("subject") % 4 == 0).alias("rejected"))))
query("ratings_common_items", f"WITH {X.RATINGS} SELECT compound, const, subject, rating FROM ratings WHERE compound IN (SELECT p_brand FROM part WHERE p_size > 45) AND compound IN (SELECT compound FROM ratings WHERE rating >= 6)")(lambda s, d: R.restrict_to_common(X.ratings(s, d), X.table(s, d, "part").filter("p_size > 45").select(F.col("p_brand").alias("compound")), X.ratings(s, d).filter("rating >= 6"))[0].select(*R.COLUMNS))


def _log(s, d, compounds=40):
    rows = X.table(s, d, "lineitem")
    return rows.select(F.col("l_suppkey").cast("string").alias("workerId"), F.lit("1").alias("worktime"), F.concat((80 + F.col("l_suppkey") % 20).cast("string"), F.lit(" % (5/6)")).alias("approval"), F.concat(F.lit("c"), F.col("l_partkey") % compounds).alias("compound"), (1 + (F.col("l_orderkey") + F.col("l_linenumber")) % 8).cast("int").alias("judgement"))


_LOG = "log AS (SELECT CAST(l_suppkey AS VARCHAR) AS workerId, 80 + l_suppkey % 20 AS rate, 'c' || (l_partkey % 40) AS compound, CAST(1 + (l_orderkey + l_linenumber) % 8 AS INTEGER) AS judgement FROM lineitem)"
query("ratings_filter_users", f"WITH {_LOG} SELECT workerId, compound, judgement FROM log WHERE judgement <> 8 AND workerId IN (SELECT workerId FROM log GROUP BY 1 HAVING COUNT(*) >= 600)")(lambda s, d: R.active_judgements(_log(s, d), 600).select("workerId", "compound", "judgement"))
query("ratings_judgement_matrix", f"WITH {_LOG} SELECT compound, 'whole' AS const, workerId AS subject, CAST(judgement AS DOUBLE) AS rating FROM log WHERE judgement <> 8 AND workerId IN (SELECT workerId FROM log GROUP BY 1 HAVING COUNT(*) >= 10)")(lambda s, d: R.judgement_matrix(_log(s, d)))
query("ratings_inattentive", f"WITH {_LOG.replace('% 40', '% 997')} SELECT workerId, COUNT(*) AS n FROM log WHERE workerId NOT IN (SELECT workerId FROM log WHERE compound = 'c3' AND judgement <> 8) GROUP BY 1")(lambda s, d: R.drop_inattentive(_log(s, d, 997), s.createDataFrame([("c3",)], "compound string")).groupBy("workerId").agg(F.count("*").alias("n")))
query("ratings_approved", f"WITH {_LOG} SELECT workerId, COUNT(*) AS n FROM log WHERE rate >= 90 GROUP BY 1")(lambda s, d: R.approved(_log(s, d)).groupBy("workerId").agg(F.count("*").alias("n")))
query("ratings_pivot", f"WITH {X.RATINGS} SELECT compound, const, {', '.join(f'MIN(rating) FILTER (subject = {k}) AS s{k}' for k in range(5))} FROM ratings GROUP BY 1, 2")(lambda s, d: R.wide_form(X.ratings(s, d).filter("subject < 5").unionByName(X.ratings(s, d).select("compound", "const").distinct().withColumns({"subject": F.lit(99).cast("bigint"), "rating": F.lit(0.0)})), list(range(5))).toDF("compound", "const", *(f"s{k}" for k in range(5))))
query("ratings_melt", f"WITH {X.RATINGS} SELECT compound, const, CAST(subject AS VARCHAR) AS subject, rating FROM ratings")(lambda s, d: R.long_form(R.wide_cells(X.ratings(s, d))))


@query("ratings_banded", f"WITH {X.RATINGS}, w AS (SELECT compound, AVG(rating) AS a, stddev_samp(rating) AS sd FROM ratings GROUP BY 1) SELECT compound, 'a' AS variable, {r6('a', 'mean')}, {r6('sd', 'std')}, {r6('a - 2 * sd', 'low')}, {r6('a + 2 * sd', 'high')} FROM w UNION ALL SELECT compound, 'b', {r6('a + 1', 'mean')}, {r6('sd', 'std')}, {r6('a', 'low')}, {r6('a + 2', 'high')} FROM w")
def ratings_banded(s, d):
    w = X.ratings(s, d).groupBy("compound").agg(F.avg("rating").alias("a"), F.stddev_samp("rating").alias("a_std"))
    w = w.withColumns({"a_low": F.col("a") - 2 * F.col("a_std"), "a_high": F.col("a") + 2 * F.col("a_std"), "b": F.col("a") + 1, "b_std": F.col("a_std"), "b_low": F.col("a"), "b_high": F.col("a") + 2})
    return R.banded_results(w, ["a", "b"], ["compound"])


_WHOLE = "wholes AS (SELECT compound, AVG(rating) AS whole FROM ratings WHERE const LIKE 'S%' GROUP BY 1), parts AS (SELECT compound, const, AVG(rating) AS mean FROM ratings WHERE const NOT LIKE 'S%' GROUP BY 1, 2)"


@query("ratings_compare", f"WITH {X.RATINGS}, {_WHOLE}, c AS (SELECT 'sum' AS method, compound, SUM(mean) AS mean FROM parts GROUP BY compound UNION ALL SELECT 'hmean', compound, 2 * product(mean) / SUM(mean) FROM parts GROUP BY compound), b AS (SELECT method, round(mean, 9) AS mean, round(whole, 9) AS whole FROM c JOIN (SELECT compound, AVG(m) AS whole FROM (SELECT compound, const, AVG(rating) AS m FROM ratings WHERE const = 'STANDARD' GROUP BY 1, 2) GROUP BY 1) USING (compound)), {spearman_sql('b', 'mean', 'whole', 'method')} SELECT method, {r6('rho', 'rho')}, n FROM rho")
def ratings_compare(s, d):
    r = X.ratings(s, d)
    means = R.aggregate(r.filter("const NOT LIKE 'S%'"))
    wholes = R.aggregate(r.filter("const = 'STANDARD'")).select("compound", F.round("mean", 9).alias("whole"))
    both = R.combine(means, "sum").withColumn("method", F.lit("sum")).unionByName(R.combine(means, "hmean").withColumn("method", F.lit("hmean")))
    return stats.spearman(both.withColumn("mean", F.round("mean", 9)).join(wholes, "compound"), "mean", "whole", "method")


# --- norms and features ---------------------------------------------------------------------------

query("assoc_counts", "WITH r AS (SELECT p_brand AS cue, UNNEST(string_split(p_type || ', ' || p_name || ',' || p_type, ',')) AS response FROM part) SELECT cue, trim(response) AS response, COUNT(*) AS count FROM r WHERE trim(response) <> '' GROUP BY 1, 2")(lambda s, d: N.count_associations(X.table(s, d, "part").select(F.col("p_brand").alias("word"), F.lit("").alias("flag"), F.concat("p_type", F.lit(", "), "p_name", F.lit(","), "p_type").alias("responses"))))
query("assoc_usable", f"WITH {X.NORMS} SELECT cue, response, count FROM norms WHERE cue <> response AND cue LIKE 'P%' AND response LIKE '%2'")(lambda s, d: N.usable_associations(X.norms(s, d), X.norms(s, d).filter("cue LIKE 'P%'").select(F.col("cue").alias("word")).unionByName(X.norms(s, d).filter("response LIKE '%2'").select(F.col("response").alias("word")))))
query("assoc_dropped", f"WITH {X.NORMS} SELECT COUNT(*) AS n, COUNT(*) FILTER (cue = response) AS own, COUNT(*) FILTER (cue NOT LIKE 'P%') AS unknown_cue, COUNT(*) AS unknown_response FROM norms")(lambda s, d: N.dropped_counts(X.norms(s, d), X.norms(s, d).filter("cue LIKE 'P%'").select(F.col("cue").alias("word"))))
query("assoc_response_totals", f"WITH {X.NORMS} SELECT response, CAST(SUM(count) AS BIGINT) AS total FROM norms GROUP BY 1")(lambda s, d: N.response_totals(X.norms(s, d)))


def _ranked(s, d, descending=False):
    return stats.percentile_rank(X.pairs(s, d), "value", "target", descending=descending)


query("assoc_percentile_asc", f"WITH {X.PAIRS} SELECT target, context, value, {r6('ceil(' + _RANK.format(g='target', x='value') + ') / COUNT(*) OVER (PARTITION BY target)', 'pct')} FROM pairs")(lambda s, d: _ranked(s, d))
query("assoc_percentile_desc", f"WITH {X.PAIRS} SELECT target, context, value, {r6('ceil(COUNT(*) OVER (PARTITION BY target) + 1 - (' + _RANK.format(g='target', x='value') + ')) / COUNT(*) OVER (PARTITION BY target)', 'pct')} FROM pairs")(lambda s, d: _ranked(s, d, True))


def _ranked_pairs(s, d):
    r = stats.percentile_rank(X.pairs(s, d), "value", "target")
    return r.select(F.col("target").alias("left"), F.concat("context", F.lit("/NN")).alias("right"), "pct")


def _segment_norms(s, d):
    return X.pairs(s, d).groupBy(word_of(F.col("target")).alias("cue"), F.col("context").alias("response")).agg(F.count("*").alias("count")).filter("response LIKE '%2' OR response LIKE '%3'")


_RANKED = f"""ranked AS (SELECT split_part(target, '/', 1) AS cue, context AS response, ceil({_RANK.format(g='target', x='value')}) / COUNT(*) OVER (PARTITION BY target) AS pct FROM pairs),
sn AS (SELECT split_part(target, '/', 1) AS cue, context AS response, COUNT(*) AS count FROM pairs WHERE context LIKE '%2' OR context LIKE '%3' GROUP BY 1, 2),
hits AS (SELECT cue, response, MAX(count) AS count, MAX(pct) AS pct FROM ranked JOIN sn USING (cue, response) WHERE pct > 0 GROUP BY 1, 2)"""
query("assoc_best_hits", f"WITH {X.PAIRS}, {_RANKED} SELECT cue, response, count, {r6('pct', 'pct')} FROM hits")(lambda s, d: N.best_hits(_ranked_pairs(s, d), _segment_norms(s, d)))
_REP = "rep AS (SELECT pct FROM hits, LATERAL (SELECT UNNEST(range(count))))"
_SHARES = ((0.05, 5), (0.1, 10), (0.25, 25), (0.5, 50), (0.75, 75), (0.9, 90), (0.95, 95))
query("assoc_ranked_norms", f"WITH {X.PAIRS}, {_RANKED}, rep AS (SELECT pct, UNNEST(range(count)) AS k FROM hits) SELECT COUNT(*) AS n, {r6('AVG(pct)', 'mean')}, {r6('stddev_pop(pct)', 'std')}, {', '.join(r6(f'quantile_cont(pct, {s})', f'p{k}') for s, k in _SHARES)}, {r6('SUM(pct) / (SELECT SUM(count) FROM sn)', 'coverage_mean')} FROM rep")(lambda s, d: N.ranked_norms(_ranked_pairs(s, d), _segment_norms(s, d)))
# cosines of the segments' rows of one nation with all rows; weights are moved about 0, so that some cosines are negative and words lack contexts
_VSM = f"""{X.PAIRS}, sp AS (SELECT target, context, value - 1000 AS value FROM pairs WHERE value - 1000 <> 0 AND {X.u_sql("9", "target", "context")} < 0.3),
sn AS (SELECT split_part(target, '/', 1) AS cue, split_part(context, '#', 2) AS b, COUNT(*) AS count FROM pairs GROUP BY 1, 2),
norms AS (SELECT cue, CASE WHEN CAST(b AS INT) % 3 = 0 THEN cue WHEN CAST(b AS INT) % 3 = 1 THEN 'none' ELSE ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'][CAST(b AS INT) % 5 + 1] END AS response, CAST(SUM(count) AS BIGINT) AS count FROM sn GROUP BY 1, 2),
len AS (SELECT target, sqrt(SUM(value * value)) AS l FROM sp GROUP BY 1), allw AS (SELECT COUNT(*) AS n FROM len),
cosines AS (SELECT split_part(a.target, '/', 1) AS cue, b.target AS word, round(coalesce((SELECT SUM(x.value * y.value) FROM sp x JOIN sp y USING (context) WHERE x.target = a.target AND y.target = b.target), 0) / (a.l * b.l), 12) AS c FROM len a, len b WHERE a.target LIKE '%/NATION_7'),
pcts AS (SELECT cue, word, ceil({_RANK.format(g="cue", x="c")}) / COUNT(*) OVER (PARTITION BY cue) AS pct FROM cosines)"""


def _vsm(s, d):
    pairs = stored(X.pairs(s, d))
    space = pairs.withColumn("value", F.col("value") - 1000).filter(uniform(9, "target", "context") < 0.3)
    b = F.split("context", "#")[1].cast("int")
    response = F.when(b % 3 == 0, F.col("cue")).when(b % 3 == 1, F.lit("none")).otherwise(F.element_at(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"))), b % 5 + 1))
    norms = pairs.withColumn("cue", word_of(F.col("target"))).groupBy("cue", response.alias("response")).agg(F.count("*").alias("count"))
    return N.association_pipeline(space, norms, "/NATION_7").select("n", "mean", "std", "p5", "p50", "p95", "own", "unknown", "higher")


query("assoc_pipeline", f"""WITH {_VSM}, ok AS (SELECT cue, response, count FROM norms WHERE cue <> response AND response IN (SELECT split_part(target, '/', 1) FROM len) AND cue IN (SELECT split_part(target, '/', 1) FROM len)),
hits AS (SELECT cue, response, MAX(count) AS count, MAX(pct) AS pct, COUNT(*) AS forms FROM ok JOIN pcts USING (cue) WHERE split_part(word, '/', 1) = response GROUP BY 1, 2), rep AS (SELECT pct, UNNEST(range(count)) AS k FROM hits)
SELECT COUNT(*) AS n, {r6("AVG(pct)", "mean")}, {r6("stddev_pop(pct)", "std")}, {r6("quantile_cont(pct, 0.05)", "p5")}, {r6("quantile_cont(pct, 0.5)", "p50")}, {r6("quantile_cont(pct, 0.95)", "p95")}, (SELECT COUNT(*) FROM norms WHERE cue = response) AS own,
  (SELECT COUNT(*) FROM norms WHERE cue <> response) - (SELECT COUNT(*) FROM ok) AS unknown, CAST((SELECT SUM(forms - 1) FROM hits) AS BIGINT) AS higher FROM rep""")(_vsm)
query("feat_totals", "SELECT p_type AS feature, CAST(SUM(p_size) AS BIGINT) AS total FROM part GROUP BY 1")(lambda s, d: N.feature_totals(X.table(s, d, "part").select(F.col("p_type").alias("feature"), F.col("p_size").alias("cnt"))))
query("feat_suggest", f"WITH {X.FEATURES}, c AS (SELECT a.feature, b.feature AS other, CAST(levenshtein(a.feature, b.feature) AS DOUBLE) AS distance, ln(b.total) / levenshtein(a.feature, b.feature) AS weight FROM features a JOIN features b ON a.feature <> b.feature), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY feature ORDER BY weight DESC, other) AS INTEGER) AS rank FROM c) SELECT feature, other, distance, {r6('weight', 'weight')}, rank FROM k WHERE rank <= 5")(lambda s, d: N.suggestions(X.features(s, d)))


def _prefixed(s, d):
    prefix = F.element_at(F.array(*map(F.lit, ("ist", "es ist", "sind", "hat", "es hat", "haben"))), (F.col("p_size") % 6 + 1).cast("int"))
    return X.table(s, d, "part").select(F.col("p_brand").alias("cue"), F.concat_ws(" ", prefix, "p_type").alias("resp"))


_PREFIX = """n AS (SELECT p_brand AS cue, ['ist', 'es ist', 'sind', 'hat', 'es hat', 'haben'][p_size % 6 + 1] AS variant, p_type AS stem FROM part),
g AS (SELECT *, CASE WHEN variant IN ('ist', 'es ist', 'sind') THEN 'ist' ELSE 'hat' END AS canonical FROM n),
ok AS (SELECT canonical, stem FROM g GROUP BY 1, 2 HAVING COUNT(DISTINCT variant) >= 2)"""
query("feat_prefix_groups", f"WITH {_PREFIX} SELECT canonical, variant, stem, string_agg(DISTINCT cue, ',' ORDER BY cue) AS cues FROM g JOIN ok USING (canonical, stem) GROUP BY 1, 2, 3")(lambda s, d: N.prefix_variants(_prefixed(s, d)).withColumn("cues", F.array_join("cues", ",")))

# --- noise ----------------------------------------------------------------------------------------

_GRID = "grid AS (SELECT i.compound, i.const, s.subject, r.rating FROM (SELECT DISTINCT compound, const FROM ratings) i CROSS JOIN (SELECT DISTINCT subject FROM ratings) s LEFT JOIN ratings r USING (compound, const, subject))"
_CELL = ("compound", "const", "subject")
query("noise_uniform", f"WITH {X.RATINGS}, {_GRID}, n AS (SELECT compound, const, subject, CASE WHEN {X.u_sql('42a', *_CELL)} < 0.2 THEN 1 + floor({X.u_sql('42b', *_CELL)} * 7) ELSE rating END AS rating FROM grid) SELECT * FROM n WHERE rating IS NOT NULL")(lambda s, d: noise.randomize(X.ratings(s, d), 0.2))
query("noise_offset", f"WITH {X.RATINGS} SELECT compound, const, subject, CASE WHEN {X.u_sql('42a', *_CELL)} < 0.3 THEN CASE WHEN {X.u_sql('42b', *_CELL)} < 0.5 THEN (rating + 3 - 1) % 7 + 1 ELSE (rating - 3 - 1 + 7) % 7 + 1 END ELSE rating END AS rating FROM ratings")(lambda s, d: noise.offset(X.ratings(s, d), 0.3))
query("noise_blank", f"WITH {X.RATINGS} SELECT * FROM ratings WHERE {X.u_sql('42a', *_CELL)} >= 0.25")(lambda s, d: noise.blank(X.ratings(s, d), 0.25))
query("noise_add", f"WITH {X.RATINGS}, f AS (SELECT compound, const, 'fake' || k AS subject FROM (SELECT DISTINCT compound, const FROM ratings), (SELECT UNNEST(range(1, 4)) AS k)) SELECT compound, const, CAST(subject AS VARCHAR) AS subject, rating FROM ratings UNION ALL SELECT compound, const, subject, 1 + floor({X.u_sql('42b', *_CELL)} * 7) FROM f")(lambda s, d: noise.add_subjects(X.ratings(s, d), 3).select(*R.COLUMNS))
_CHOSEN = f"chosen AS (SELECT subject FROM (SELECT DISTINCT subject FROM ratings) ORDER BY {X.u_sql('42s', 'subject')}, subject LIMIT 5)"
query("noise_replace", f"WITH {X.RATINGS}, {_CHOSEN}, f AS (SELECT compound, const, subject FROM (SELECT DISTINCT compound, const FROM ratings), chosen) SELECT compound, const, subject, rating FROM ratings WHERE subject NOT IN (SELECT subject FROM chosen) UNION ALL SELECT compound, const, subject, 1 + floor({X.u_sql('42b', *_CELL)} * 7) FROM f")(lambda s, d: noise.replace_subjects(X.ratings(s, d), 5).select(*R.COLUMNS))
query("noise_blank_subjects", f"WITH {X.RATINGS}, {_CHOSEN} SELECT * FROM ratings WHERE subject NOT IN (SELECT subject FROM chosen)")(lambda s, d: noise.blank_subjects(X.ratings(s, d), 5).select(*R.COLUMNS))
_HOLD = f"t AS (SELECT trial, ratings.* FROM ratings, (SELECT UNNEST(range(1, 6)) AS trial)), h AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY {X.u_sql('42', 'trial', *_CELL)}, compound, const, subject) <= 50 AS held FROM t), seen AS (SELECT * FROM h WHERE NOT held)"
_PREDICT = f"""WITH {X.RATINGS}, {_HOLD}, mo AS (SELECT trial, rating AS common FROM (SELECT trial, rating, COUNT(*) AS n FROM seen GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY trial ORDER BY n DESC, rating) = 1),
al AS (SELECT trial, AVG(rating) AS a FROM seen GROUP BY 1), it AS (SELECT trial, compound, const, AVG(rating) AS i FROM seen GROUP BY 1, 2, 3), su AS (SELECT trial, subject, AVG(rating) AS s FROM seen GROUP BY 1, 2),
g AS (SELECT h.trial, h.rating, common, COALESCE(i, a) AS item, COALESCE(s, a) AS subject_mean FROM h JOIN mo USING (trial) JOIN al USING (trial) LEFT JOIN it USING (trial, compound, const) LEFT JOIN su USING (trial, subject) WHERE held)"""
_MODELS = {"common": "common", "item": "item", "subject_mean": "subject_mean", "item_subject": "sqrt(item * subject_mean)"}
query("predict_errors", _PREDICT + ", e AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, trial, sqrt(AVG(pow(rating - {x}, 2))) AS v FROM g GROUP BY trial" for m, x in _MODELS.items()) + f") SELECT model, {r6('AVG(v)', 'mean')}, {r6('stddev_samp(v)', 'std')}, COUNT(*) AS trials, {r6('AVG(v) - 2 * stddev_samp(v)', 'low')}, {r6('AVG(v) + 2 * stddev_samp(v)', 'high')} FROM e GROUP BY model")(lambda s, d: noise.prediction_errors(X.ratings(s, d), 50, 5))


def _parts(s, d):
    return X.ratings(s, d).filter("const NOT LIKE 'S%'"), X.ratings(s, d).filter("const = 'STANDARD'")


_BASE = f"{X.RATINGS}, base AS (SELECT CASE WHEN const = 'STANDARD' THEN 'w' ELSE 'p' END AS side, * FROM ratings WHERE const NOT LIKE 'S%' OR const = 'STANDARD')"
_OFFSET = f"""moved AS (SELECT side, trial, compound, const, subject, CASE WHEN {X.u_sql("42a", "trial", *_CELL)} < 0.2 THEN CASE WHEN {X.u_sql("42b", "trial", *_CELL)} < 0.5 THEN (rating + 3 - 1) % 7 + 1 ELSE (rating - 3 - 1 + 7) % 7 + 1 END ELSE rating END AS rating FROM base, nums)"""
# what is compared, spelt out; cleaned parts with cleaned wholes of the original ratings (Q19)
_PAIRS = """noisy_noisy p_noisy w_noisy, clean_noisy p_clean w_noisy, noisy_clean p_noisy w_clean, clean_clean p_clean w_clean, noisy_orig p_noisy w_orig, clean_orig p_clean w_orig, orig_noisy p_orig w_noisy, orig_clean p_orig w_clean,
orig_orig p_orig w_orig, cleanorig_orig p_cleanorig w_orig, cleanorig_noisy p_cleanorig w_noisy, cleanorig_clean p_cleanorig w_clean, orig_cleanorig p_orig w_cleanorig, noisy_cleanorig p_noisy w_cleanorig, clean_cleanorig p_clean w_cleanorig"""


def _random_subjects(most: str) -> str:
    """CTEs of ratings in which some subjects of each side and trial rate at random."""
    return f"""t AS (SELECT side, trial, compound, const, subject, rating FROM base, nums),
people AS (SELECT DISTINCT side, trial, subject FROM t),
chosen AS (SELECT side, trial, subject FROM people QUALIFY row_number() OVER (PARTITION BY side, trial ORDER BY {X.u_sql("42s", "trial", "subject")}, subject) <= {most.format(people="COUNT(*) OVER (PARTITION BY side, trial)")}),
moved AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.side = t.side AND c.trial = t.trial AND c.subject = t.subject)
  UNION ALL SELECT i.side, i.trial, compound, const, subject, 1 + floor({X.u_sql("42b", "i.trial", *_CELL)} * 7) FROM (SELECT DISTINCT side, trial, compound, const FROM t) i JOIN chosen c ON c.side = i.side AND c.trial = i.trial)"""


def _agree(key: str) -> str:
    """CTEs up to placed: agreements (rho) and places of subjects among the runs of raw."""
    rho = spearman_sql("o", "rating", "others", f"{key}, subject").replace("rk AS (", "ra AS (").replace("FROM rk", "FROM ra").replace(", rho AS (", ", agree AS (")
    return f"""o AS (SELECT *, round((SUM(rating) OVER w - rating) / nullif(COUNT(*) OVER w - 1, 0), 9) AS others FROM raw WINDOW w AS (PARTITION BY {key}, compound, const)), {rho},
placed AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(rho, 9), subject) AS place FROM agree)"""


_WIPE = "kept AS (SELECT '{0}' AS cleaner, raw.* FROM raw LEFT JOIN placed USING (version, side, trial, subject) LEFT JOIN (SELECT version, side, trial, COUNT(DISTINCT subject) AS people FROM raw GROUP BY ALL) USING (version, side, trial) WHERE coalesce(place > {1}, true))"
_ZKEPT = """z AS (SELECT *, COUNT(*) OVER w AS n, SUM(rating) OVER w AS s, SUM(rating * rating) OVER w AS q FROM raw WINDOW w AS (PARTITION BY version, side, trial, compound, const)),
kept AS (SELECT 'none' AS cleaner, version, side, trial, compound, const, subject, rating FROM raw UNION ALL
  SELECT 'z1.0', version, side, trial, compound, const, subject, rating FROM z WHERE n * q > s * s AND (n * rating - s) * (n * rating - s) * (n - 1) <= n * (n * q - s * s))"""


def noisy_sql(moved: str, kept: str, count: int, level: str) -> str:
    """The noise experiment: ``moved`` and ``kept`` are CTEs of noisy and of cleaned ratings."""
    pairs = " UNION ALL ".join("SELECT a.cleaner, a.trial, '{}' AS variable, a.m AS x, b.m AS y FROM every a JOIN every b USING (cleaner, trial, compound) WHERE a.name = '{}' AND b.name = '{}'".format(*p.split()) for p in _PAIRS.split(","))
    return f"""WITH {_BASE}, nums AS (SELECT UNNEST(range(1, {count + 1})) AS trial), {moved},
raw AS (SELECT 'orig' AS version, side, 0 AS trial, compound, const, subject, rating FROM base UNION ALL SELECT 'noisy', side, trial, compound, const, subject, rating FROM moved),
{kept},
v AS (SELECT cleaner, version, side, trial, compound, const, subject, rating FROM raw, (SELECT DISTINCT cleaner FROM kept) UNION ALL SELECT cleaner, CASE version WHEN 'orig' THEN 'cleanorig' ELSE 'clean' END, side, trial, compound, const, subject, rating FROM kept),
means AS (SELECT cleaner, version, side, trial, compound, const, AVG(rating) AS m FROM v GROUP BY ALL),
scores AS (SELECT cleaner, version, side, trial, compound, round(CASE side WHEN 'p' THEN sqrt(product(m)) ELSE AVG(m) END, 9) AS m FROM means GROUP BY cleaner, version, side, trial, compound),
every AS (SELECT cleaner, side || '_' || version AS name, compound, m, CASE WHEN scores.trial = 0 THEN nums.trial ELSE scores.trial END AS trial FROM scores JOIN nums ON scores.trial = 0 OR scores.trial = nums.trial),
pairs AS ({pairs}),
{spearman_sql("pairs", "x", "y", "cleaner, trial, variable")},
counts AS (SELECT cleaner, trial, CASE side WHEN 'p' THEN 'indiv_' ELSE 'whole_' END || version || '_notblank' AS variable, CAST(COUNT(*) AS DOUBLE) AS value FROM v WHERE version <> 'cleanorig' GROUP BY ALL),
vals AS (SELECT cleaner, trial, variable, rho AS value FROM rho UNION ALL SELECT cleaner, nums.trial, variable, value FROM counts JOIN nums ON counts.trial = 0 OR counts.trial = nums.trial)
SELECT cleaner, variable, {r6("AVG(value)", "mean")}, {r6("stddev_samp(value)", "std")}, COUNT(*) AS trials, {r6("AVG(value) - 2 * stddev_samp(value)", "low")}, {r6("AVG(value) + 2 * stddev_samp(value)", "high")}, {level} FROM vals GROUP BY cleaner, variable"""


query("noise_experiment", noisy_sql(_OFFSET, _ZKEPT, 5, "CAST(0.2 AS DOUBLE) AS p_noise"))(lambda s, d: noise.grid("zscore", *_parts(s, d), noise.offset, [0.2], [1.0], 5))
_RUN = "version, side, trial"
query("noise_min_rho", " UNION ALL ".join(f"SELECT * FROM ({noisy_sql(_random_subjects(str(n)), _agree(_RUN) + ', ' + _WIPE.format('minrho', n), 3, f'CAST({n} AS INTEGER) AS n')})" for n in (2, 5)))(lambda s, d: noise.grid("minrho", *_parts(s, d), [2, 5], 3))
query("noise_drop_subjects", " UNION ALL ".join(f"SELECT * FROM ({noisy_sql(_random_subjects(f'ceil({p} * {{people}})'), _agree(_RUN) + ', ' + _WIPE.format('devsubj', f'ceil({p} * people)'), 3, f'CAST({p} AS DOUBLE) AS p')})" for p in (0.1, 0.2)))(lambda s, d: noise.grid("dropsubj", *_parts(s, d), [0.1, 0.2], 3))

# every threshold of agreement and of z-scores of the study, as rows
_RHOS, _ZSCORES = steps(0.10, 0.6, 0.05), steps(1.0, 4.0, 0.25)
_SETTINGS = cleanup.grid_settings(_RHOS, _ZSCORES)
_LINKS = f"links AS (SELECT p_brand AS compound, p_type AS const, {X.u_sql('5', 'p_brand', 'p_type')} AS jaccard FROM part GROUP BY 1, 2)"


def _links(s, d):
    return X.table(s, d, "part").select(F.col("p_brand").alias("compound"), F.col("p_type").alias("const")).distinct().withColumn("jaccard", uniform(5, "compound", "const"))


_WHOLES = "SELECT {0}compound, round(AVG(mean), 9) AS y FROM {1} WHERE side = 'w' GROUP BY {0}compound"
_TOGETHER = "SELECT {0}compound, round(product(mean), 9) AS x FROM {1} WHERE side = 'p' GROUP BY {0}compound"
query("cleanup_grid", f"""WITH {_BASE}, {_LINKS},
common AS (SELECT compound FROM base WHERE side = 'p' INTERSECT SELECT compound FROM base WHERE side = 'w' INTERSECT SELECT compound FROM links),
raw AS (SELECT * FROM base WHERE compound IN (SELECT compound FROM common)), {_agree("side")},
settings(setting, kind, value) AS (VALUES {', '.join(f"('{k}', '{kind}', CAST({v!r} AS DOUBLE))" for k, (kind, v) in _SETTINGS.items())}),
z AS (SELECT raw.*, rho, COUNT(*) OVER w AS n, SUM(rating) OVER w AS s, SUM(rating * rating) OVER w AS q FROM raw LEFT JOIN placed USING (side, subject) WINDOW w AS (PARTITION BY side, compound, const)),
kept AS (SELECT setting, z.* FROM z, settings WHERE CASE kind WHEN 'min_rho' THEN coalesce(round(rho, 9) >= value, true) WHEN 'zscore' THEN n * q > s * s AND (n * rating - s) * (n * rating - s) * (n - 1) <= n * (n * q - s * s) * (value * value) ELSE true END),
m AS (SELECT setting, side, compound, const, AVG(rating) AS mean, COUNT(*) AS n FROM kept GROUP BY ALL), m0 AS (SELECT side, compound, const, AVG(rating) AS mean, COUNT(*) AS n FROM raw GROUP BY ALL),
e AS (SELECT setting, 'parts_cleaned' AS variable, x, y FROM ({_TOGETHER.format("setting, ", "m")}) JOIN ({_WHOLES.format("", "m0")}) USING (compound)
  UNION ALL SELECT setting, 'parts_and_whole_cleaned', x, y FROM ({_TOGETHER.format("setting, ", "m")}) JOIN ({_WHOLES.format("setting, ", "m")}) USING (setting, compound)
  UNION ALL SELECT setting, 'whole_cleaned', x, y FROM ({_TOGETHER.format("", "m0")}) JOIN ({_WHOLES.format("setting, ", "m")}) USING (compound)
  UNION ALL SELECT setting, 'associations_indiv', round(mean, 9), jaccard FROM m JOIN links USING (compound, const) WHERE side = 'p'
  UNION ALL SELECT setting, 'associations_whole', x, y FROM (SELECT compound, round(sqrt(product(jaccard)), 9) AS x FROM links WHERE compound <> const GROUP BY compound) JOIN ({_WHOLES.format("setting, ", "m")}) USING (compound)),
{spearman_sql("e", "x", "y", "setting, variable")},
c AS (SELECT setting, coalesce(SUM(n) FILTER (side = 'p'), 0) AS p, coalesce(SUM(n) FILTER (side = 'w'), 0) AS w FROM m GROUP BY setting), c0 AS (SELECT SUM(n) FILTER (side = 'p') AS p0, SUM(n) FILTER (side = 'w') AS w0 FROM m0)
SELECT setting, {r6("p / p0", "retained_indiv")}, {r6("w / w0", "retained_whole")}, {r6("(p + w) / (p0 + w0)", "retained_both")}, variable, {r6("rho", "value")} FROM rho JOIN c USING (setting), c0""")(lambda s, d: cleanup.cleanup_grid(*_parts(s, d), _links(s, d), _SETTINGS))
query("standard_cleanup", f"""WITH {_BASE.replace("base AS", "b0 AS")}, raw AS (SELECT * FROM b0 WHERE side = 'p'), {_agree("side")},
base AS (SELECT raw.* FROM raw LEFT JOIN agree USING (side, subject) WHERE coalesce(rho >= -0.05, true)),
z AS (SELECT *, COUNT(*) OVER w AS n, SUM(rating) OVER w AS s, SUM(rating * rating) OVER w AS q FROM base WINDOW w AS (PARTITION BY compound, const)),
means AS (SELECT compound, const, AVG(rating) AS mean FROM z WHERE n * q > s * s AND (n * rating - s) * (n * rating - s) * (n - 1) <= n * (n * q - s * s) * 2.25 GROUP BY ALL),
y AS (SELECT compound, round(AVG(mean), 9) AS y FROM (SELECT compound, const, AVG(rating) AS mean FROM b0 WHERE side = 'w' GROUP BY ALL) GROUP BY compound),
e AS (SELECT 'sum' AS method, round(SUM(mean), 9) AS x, any_value(y) AS y FROM means JOIN y USING (compound) GROUP BY compound UNION ALL SELECT 'prod', round(product(mean), 9), any_value(y) FROM means JOIN y USING (compound) GROUP BY compound),
{spearman_sql("e", "x", "y", "method")} SELECT method, {r6("rho", "rho")}, n FROM rho""")(lambda s, d: cleanup.standard_cleanup([_parts(s, d)[0]], -0.05, 1.5, _parts(s, d)[1])["against_whole"])

# --- statistics -----------------------------------------------------------------------------------

query("sig_test", f"""WITH o AS (SELECT doc_id AS id, quality AS a, toxic AS b FROM labels), ob AS (SELECT AVG(a) - AVG(b) AS observed FROM o),
t AS (SELECT trial, CASE WHEN {X.u_sql('42', 'trial', 'id')} < 0.5 THEN b ELSE a END AS x, CASE WHEN {X.u_sql('42', 'trial', 'id')} < 0.5 THEN a ELSE b END AS y FROM o, (SELECT UNNEST(range(1, 201)) AS trial)),
dl AS (SELECT trial, AVG(x) - AVG(y) AS delta FROM t GROUP BY trial)
SELECT {r6('observed', 'observed')}, COUNT(*) FILTER (abs(delta) >= abs(observed) - 1e-12) AS hits, COUNT(*) AS trials, {r6('(COUNT(*) FILTER (abs(delta) >= abs(observed) - 1e-12) + 1) / (COUNT(*) + 1)', 'p')} FROM dl, ob GROUP BY observed""")(lambda s, d: stats.randomization_test(X.outputs(s, d), 200))
query("stat_column_rho", f"WITH c AS (SELECT * FROM (SELECT 'p_size' AS l, 'p_retailprice' AS r, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part) UNION ALL SELECT 'p_partkey', 'p_size', CAST(p_partkey AS DOUBLE), CAST(p_size AS DOUBLE) FROM part UNION ALL SELECT 'p_partkey', 'p_retailprice', CAST(p_partkey AS DOUBLE), p_retailprice FROM part), {spearman_sql('c', 'x', 'y', 'l, r')} SELECT l AS \"left\", r AS \"right\", {r6('rho', 'rho')}, n FROM rho")(lambda s, d: stats.column_correlations(X.table(s, d, "part").select("p_partkey", "p_size", "p_retailprice")))
query("stat_weighted", "WITH e AS (SELECT l_returnflag, l_discount AS v, CAST(l_quantity AS BIGINT) AS c FROM lineitem), r AS (SELECT l_returnflag, v, UNNEST(range(c)) AS k FROM e) SELECT l_returnflag, COUNT(*) AS n, " + f"{r6('AVG(v)', 'mean')}, {r6('stddev_pop(v)', 'std')}, {', '.join(r6(f'quantile_cont(v, {s})', f'p{k}') for s, k in _SHARES)} FROM r GROUP BY 1")(lambda s, d: stats.weighted_summary(X.table(s, d, "lineitem").select("l_returnflag", "l_discount", F.col("l_quantity").cast("bigint").alias("c")), "l_discount", "c", "l_returnflag"))
query("stat_trials", f"WITH t AS (SELECT l_returnflag AS g, AVG(l_discount) AS v FROM lineitem GROUP BY l_returnflag, l_suppkey) SELECT g, {r6('AVG(v)', 'mean')}, {r6('stddev_samp(v)', 'std')}, COUNT(*) AS trials, {r6('AVG(v) - 2 * stddev_samp(v)', 'low')}, {r6('AVG(v) + 2 * stddev_samp(v)', 'high')}, {r6('AVG(v) - 2 * stddev_samp(v) / sqrt(COUNT(*))', 'band_low')}, {r6('AVG(v) + 2 * stddev_samp(v) / sqrt(COUNT(*))', 'band_high')} FROM t GROUP BY g")(lambda s, d: stats.confidence_band(stats.trial_summary(X.table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), "l_suppkey").agg(F.avg("l_discount").alias("v")), "v", "g")))
query("stat_histogram", f"WITH b AS (SELECT CAST(least(floor(l_quantity / 5.0), 9) AS INTEGER) AS bin FROM lineitem WHERE l_quantity BETWEEN 0 AND 50) SELECT bin, COUNT(*) AS n, {r6('COUNT(*) / (SELECT COUNT(*) FROM b) / 5.0', 'density')} FROM b GROUP BY bin")(lambda s, d: stats.histogram(X.table(s, d, "lineitem"), "l_quantity", 0.0, 50.0, 10))
_GOLD = "gold AS (SELECT doc_id AS id, CAST(quality * 2 + doc_id % 3 AS DOUBLE) AS gold, CAST(doc_id % 7 AS DOUBLE) AS m1, CAST(toxic + doc_id % 2 AS DOUBLE) AS m2 FROM labels)"
_ACC = " UNION ALL ".join(f"SELECT '{m}' AS measure, COUNT(*) AS pairs, {r6(f'AVG(CASE WHEN (a.{m} < b.{m}) = (a.gold < b.gold) THEN 1.0 ELSE 0.0 END)', 'accuracy')}, {r6('AVG(CASE WHEN a.gold < b.gold THEN 1.0 ELSE 0.0 END)', 'baseline')} FROM gold a JOIN gold b ON a.id < b.id AND abs(a.gold - b.gold) >= 1" for m in ("m1", "m2"))
query("gold_accuracy", f"WITH {_GOLD} {_ACC}")(lambda s, d: stats.order_accuracy(X.table(s, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 2 + F.col("doc_id") % 3).cast("double").alias("gold"), (F.col("doc_id") % 7).cast("double").alias("m1"), (F.col("toxic") + F.col("doc_id") % 2).cast("double").alias("m2")), ["m1", "m2"]))
query("spearman_p")(lambda s, d: R.agreements(X.ratings(s, d)).withColumn("p", stats.spearman_p("rho", "n")))

# --- topics and corpora ---------------------------------------------------------------------------


def _model(s, d):
    return X.topics(s, d).select("topic", F.col("word").alias("item"), "p")


query("topic_top_words", f"WITH {X.TOPICS}, s AS (SELECT topic, word AS item, p / SUM(p) OVER (PARTITION BY topic) AS p FROM topics), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY p DESC, item) AS INTEGER) AS rank FROM s WHERE p > 1e-4) SELECT CAST(topic AS INTEGER) AS topic, rank, item, {r6('p', 'p')} FROM k WHERE rank <= 15")(lambda s, d: topics.top_items(_model(s, d)))
query("topic_word_topics", f"WITH {X.TOPICS} SELECT word AS item, CAST(topic AS INTEGER) AS topic, {r6('p', 'p')} FROM topics WHERE p > 0.05")(lambda s, d: topics.word_topics(_model(s, d)))
query("topic_documents", f"WITH {X.TOPICS} SELECT word AS doc, CAST(row_number() OVER (PARTITION BY word ORDER BY p DESC, topic) AS INTEGER) AS rank, CAST(topic AS INTEGER) AS topic, {r6('p', 'p')} FROM topics WHERE p > 1e-6")(lambda s, d: topics.document_topics(X.topics(s, d).select(F.col("word").alias("doc"), "topic", "p")))
query("topic_lmi", f"WITH {X.TOPICS}, s AS (SELECT topic, word AS item, p, SUM(p) OVER (PARTITION BY topic) AS t, SUM(p) OVER () AS n FROM topics) SELECT CAST(topic AS INTEGER) AS topic, item, {r6('greatest(p / n * ln((p / t) / (t / n)), 0)', 'p')} FROM s")(lambda s, d: topics.topic_lmi(_model(s, d)))
_TRACE = "tr AS (SELECT l_suppkey AS model, l_orderkey * 10 + l_linenumber AS pos, l_extendedprice AS value, l_discount AS seconds FROM lineitem)"


def _trace(s, d):
    return X.table(s, d, "lineitem").select(F.col("l_suppkey").alias("model"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_extendedprice").alias("value"), F.col("l_discount").alias("seconds"))


query("trace_cumulative", f"WITH {_TRACE} SELECT model, CAST(row_number() OVER w AS INTEGER) AS iter, {r6('value', 'value')}, {r6('seconds', 'seconds')}, {r6('SUM(seconds) OVER w', 'elapsed')} FROM tr WINDOW w AS (PARTITION BY model ORDER BY pos, value, seconds ROWS UNBOUNDED PRECEDING)")(lambda s, d: topics.cumulative_time(_trace(s, d)))
query("trace_final", f"WITH {_TRACE}, b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY pos DESC, value DESC, seconds DESC) AS k FROM tr) SELECT model, {r6('AVG(value) FILTER (k <= 5)', 'value')}, {r6('SUM(seconds)', 'seconds')} FROM b GROUP BY model")(lambda s, d: topics.final_value(_trace(s, d)))
query("corpus_parse", f"WITH {X.CORPUS} SELECT * FROM corpus")(lambda s, d: C.parse(X.corpus_lines(s, d)))
query("corpus_merged", f"WITH {X.CORPUS} SELECT doc, word, feat, feat2, CAST(SUM(count) AS INTEGER) AS count FROM corpus GROUP BY 1, 2, 3, 4")(lambda s, d: C.merged(X.corpus(s, d)))
query("corpus_lengths", f"WITH {X.CORPUS} SELECT doc, CAST(SUM(count) AS BIGINT) AS length, COUNT(*) AS items FROM corpus GROUP BY 1")(lambda s, d: C.document_lengths(X.corpus(s, d)))
query("corpus_multimodal", f"WITH {X.CORPUS}, k AS (SELECT * FROM corpus WHERE feat > 0), n AS (SELECT word AS old, CAST(row_number() OVER (ORDER BY MIN(doc), word) AS INTEGER) AS word FROM k GROUP BY word) SELECT doc, n.word, feat, feat2, count FROM k JOIN n ON k.word = n.old")(lambda s, d: C.multimodal_only(X.corpus(s, d))[0])
query("corpus_features_only", f"WITH {X.CORPUS}, f AS (SELECT doc, feat, SUM(count) AS c FROM corpus WHERE feat > 0 GROUP BY 1, 2), l AS (SELECT doc, string_agg(feat || ':' || c, ' ' ORDER BY feat) AS value FROM f GROUP BY 1) SELECT d.doc, COALESCE(value, '') AS value FROM (SELECT DISTINCT doc FROM corpus) d LEFT JOIN l ON l.doc = d.doc")(lambda s, d: C.features_only(X.corpus(s, d)))


def _feature_shares(s, d):
    return X.corpus(s, d).filter("feat > 0").groupBy("word", (F.col("feat") - 1).alias("feat")).agg(F.sum("count").cast("double").alias("p"))


_CDF = f"WITH {X.CORPUS}, f AS (SELECT word, feat - 1 AS feat, SUM(count) AS p FROM corpus WHERE feat > 0 GROUP BY 1, 2), cdf AS (SELECT word, CAST(feat + 1 AS INTEGER) AS feat, (SUM(p) OVER w - p) / SUM(p) OVER (PARTITION BY word) AS low, SUM(p) OVER w / SUM(p) OVER (PARTITION BY word) AS high FROM f WINDOW w AS (PARTITION BY word ORDER BY p DESC, feat ROWS UNBOUNDED PRECEDING))"
query("corpus_cdf", f"{_CDF} SELECT word, feat, {r6('low', 'low')}, {r6('high', 'high')} FROM cdf")(lambda s, d: C.descending_cdf(_feature_shares(s, d)))
query("corpus_inject", f"{_CDF}, few AS (SELECT doc, word, SUM(count) AS c FROM corpus GROUP BY 1, 2), dr AS (SELECT doc, word, UNNEST(range(1, CAST(c AS BIGINT) + 1)) AS draw FROM few), du AS (SELECT doc, word, {X.u_sql('42', 'doc', 'word', 'draw')} AS u FROM dr) SELECT doc, du.word, cdf.feat, CAST(0 AS INTEGER) AS feat2, CAST(COUNT(*) AS INTEGER) AS count FROM du JOIN cdf ON cdf.word = du.word AND u >= low AND u < high GROUP BY 1, 2, 3 UNION ALL SELECT doc, word, 0, 0, CAST(c AS INTEGER) FROM few WHERE word NOT IN (SELECT word FROM cdf)")(lambda s, d: C.inject_features(C.merged(X.corpus(s, d).withColumns({"feat": F.lit(0), "feat2": F.lit(0)})), C.descending_cdf(_feature_shares(s, d))))
_PICK = "CASE WHEN p_size % 2 = 0 THEN 'ADJ' WHEN p_size % 3 = 0 THEN 'NN' ELSE 'V' END"
query("order_fallback", f"""WITH w AS (SELECT DISTINCT p_name AS word, {_PICK} AS pos FROM part), v AS (SELECT DISTINCT p_name || '/' || ['ADJD', 'NN', 'ADJA', 'VVPP', 'VVINF'][p_partkey % 5 + 1] AS label FROM part WHERE p_partkey % 7 < 4),
o(pos, tag, place) AS (VALUES ('ADJ', 'ADJA', 0), ('ADJ', 'ADJD', 1), ('NN', 'NN', 0), ('V', 'VVFIN', 0), ('V', 'VVINF', 1), ('V', 'VVPP', 2), ('V', 'VVIZU', 3), ('V', 'VVIMP', 4))
SELECT word, pos, min_by(label, place) AS label FROM w JOIN o USING (pos) JOIN v ON label = word || '/' || tag GROUP BY 1, 2""")(lambda s, d: topics.resolve_tags(X.table(s, d, "part").select(F.col("p_name").alias("word"), F.expr(_PICK).alias("pos")).distinct(), X.table(s, d, "part").filter("p_partkey % 7 < 4").select(F.concat_ws("/", "p_name", F.element_at(F.array(*map(F.lit, ("ADJD", "NN", "ADJA", "VVPP", "VVINF"))), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("label"))))

# --- images and dense spaces ----------------------------------------------------------------------


def _centres(s, d):
    return [list(map(float, r["embedding"])) for r in X.table(s, d, "embeddings").filter("vec_id < 8").orderBy("vec_id").select("embedding").collect()]  # eight rows


@query("bovw", f"""WITH c AS (SELECT vec_id AS k, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 8), e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, {X.u_sql('x', 'vec_id')} AS x, {X.u_sql('y', 'vec_id')} AS y FROM embeddings),
n AS (SELECT e.*, k, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), k) AS o FROM e, c)
SELECT CAST(label AS INTEGER) AS image, CAST(8 * (floor(x * 4) * 4 + floor(y * 4)) + k AS INTEGER) AS bin, COUNT(*) AS n FROM n WHERE o = 1 GROUP BY 1, 2""")
def bovw(s, d):
    from wordloom.functions.columns import uniform

    rows = X.table(s, d, "embeddings").select(F.col("label").alias("image"), F.col("embedding").cast("array<double>").alias("values"), uniform("x", "vec_id").alias("x"), uniform("y", "vec_id").alias("y"))
    return images.visual_words(images.nearest_centre(rows, _centres(s, d)), 8)


query("rollup_vectors", f"SELECT CAST(label AS INTEGER) AS label, i - 1 AS at, {r6('SUM(CAST(embedding[i] AS DOUBLE))', 'value')} FROM embeddings, (SELECT CAST(UNNEST(range(1, 65)) AS INTEGER) AS i) GROUP BY 1, 2")(lambda s, d: images.sum_vectors(X.table(s, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vector")), "label").select("label", F.posexplode("vector").alias("at", "value")))
query("hyponyms", "WITH m AS (SELECT DISTINCT p_brand AS compound, UNNEST(string_split(p_type || ' ' || p_name, ' ')) AS orig FROM part) SELECT compound, synset FROM m JOIN (SELECT DISTINCT p_type AS orig, p_type || '-' || (p_size % 3) AS synset FROM part) USING (orig)")(lambda s, d: images.hyponym_members(X.table(s, d, "part").select(F.col("p_brand").alias("compound"), F.concat_ws(" ", "p_type", "p_name").alias("synsets")).distinct().select("compound", F.explode(F.split("synsets", " ")).alias("synsets")).distinct(), X.table(s, d, "part").select(F.col("p_type").alias("orig"), F.concat_ws("-", "p_type", F.col("p_size") % 3).alias("synset")).distinct()))


def _spaces(s, d):
    v = _vectors(s, d)
    half = lambda name, low: v.select(F.lit(name).alias("space"), "word", F.slice("vector", low, 32).alias("vector"))
    return half("a", 1).unionByName(half("b", 33))


@query("space_subsets", f"""WITH g AS (SELECT a.vec_id AS x, b.vec_id AS y, (a.vec_id * 7 + b.vec_id) % 11 AS mean, a.embedding::DOUBLE[] AS va, b.embedding::DOUBLE[] AS vb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
n AS (SELECT x, mean, va[1:32] AS a1, va[33:64] AS a2, vb[1:32] AS b1, vb[33:64] AS b2 FROM g),
u AS (SELECT x, mean, list_transform(a1, lambda v: v / list_sum(list_transform(a1, lambda z: abs(z)))) AS a1, list_transform(a2, lambda v: v / list_sum(list_transform(a2, lambda z: abs(z)))) AS a2, list_transform(b1, lambda v: v / list_sum(list_transform(b1, lambda z: abs(z)))) AS b1, list_transform(b2, lambda v: v / list_sum(list_transform(b2, lambda z: abs(z)))) AS b2 FROM n),
c AS (SELECT 'a' AS spaces, mean, round(list_cosine_similarity(a1, b1), 9) AS score FROM u UNION ALL SELECT 'b', mean, round(list_cosine_similarity(a2, b2), 9) FROM u UNION ALL SELECT 'a+b', mean, round(list_cosine_similarity(list_concat(a1, a2), list_concat(b1, b2)), 9) FROM u),
{spearman_sql('c', 'mean', 'score', 'spaces')} SELECT spaces, {r6('rho', 'rho')}, n FROM rho""")
def space_subsets(s, d):
    ids = X.table(s, d, "embeddings").select("vec_id")
    gold = ids.select(F.concat(F.lit("v"), "vec_id").alias("compound"), F.concat(F.lit("v"), F.col("vec_id") + 1).alias("const"), ((F.col("vec_id") * 7 + F.col("vec_id") + 1) % 11).cast("double").alias("mean"))
    return images.subset_experiment(_spaces(s, d), gold, ["a", "b"]).drop("p")


_SPLIT = "SELECT vec_id, 'bands' AS feature, CAST(k AS INTEGER) AS place, CAST(embedding[16 * k + 1 : 16 * k + 16] AS DOUBLE[]) AS v FROM embeddings, (SELECT UNNEST(range(4)) AS k)"
query("image_features", f"""WITH b AS ({_SPLIT}), i AS (SELECT vec_id, k, CAST(embedding AS DOUBLE[]) AS e FROM embeddings, (SELECT UNNEST(range(2, 64)) AS k)),
t AS (SELECT vec_id, list_transform(range(8), lambda j: CAST(len(list_filter(embedding, lambda x: least(greatest(floor((CAST(x AS DOUBLE) + 1) / 2 * 8), 0), 7) = j)) AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, feature, place, round(list_sum(v), 6) + 0.0 AS first, round(list_max(v), 6) + 0.0 AS last FROM b
UNION ALL SELECT vec_id, 'peaks', CAST(k - 1 AS INTEGER), round(e[k], 6) + 0.0, round(e[k], 6) + 0.0 FROM i WHERE e[k] > e[k - 1] AND e[k] > e[k + 1]
UNION ALL SELECT vec_id, 'tally', 0, v[1], v[8] FROM t""")(lambda s, d: images.described(X.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v", "bands", "peaks", "tally").select("vec_id", "feature", "place", F.get("values", 0).alias("first"), F.element_at("values", -1).alias("last")))
query("svd_reduced", f"WITH {X.PAIRS}, g AS (SELECT split_part(target, '/', 1) AS target, context, SUM(value) AS value FROM pairs GROUP BY 1, 2) SELECT target, context, round(value / sqrt(SUM(value * value) OVER (PARTITION BY target)), 6) + 0.0 AS value FROM g")(lambda s, d: factor.reduce_space(*factor.space_svd(P.norm2(P.without_pos(X.pairs(s, d))), 5)))


# --- iterative ------------------------------------------------------------------------------------

query("matrix_completion")(lambda s, d: factor.completed(factor.completion_factors(X.ratings(s, d), 2, epochs=300), 2))
query("zero_filled_svd")(lambda s, d: factor.zero_filled_svd(X.ratings(s, d), 3))


@query("svd_space")
def svd_space(s, d):
    left, sigmas, _ = factor.space_svd(P.norm2(P.without_pos(X.pairs(s, d))), 3)
    return sigmas


query("elo")(lambda s, d: matches.elo(matches.random_matches(s, X.ratings(s, d), 10 * X.ratings(s, d).count())))


@query("lda_online")
def lda_online(s, d):
    model = topic_models.OnlineTopics(topic_models.Settings(topics=5, sizes=(51, 22, 7), batch=100_000))
    model.fit(X.corpus(s, d), 1)
    return topics.top_items(model.tables(s)["word"], 5)


@query("lda_gibbs")
def lda_gibbs(s, d):
    model = topic_models.GibbsTopics(topic_models.Settings(topics=5, sizes=(51, 22))).fit(X.corpus(s, d), 2)
    return topics.top_items(model.tables(s)["word"], 5)
