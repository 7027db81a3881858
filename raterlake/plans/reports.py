"""Queries of reports over raters, folds and parameters, and of metrics by class."""

from __future__ import annotations

from pyspark.sql import functions as F

from raterlake.functions import arrays, scalar
from raterlake.operators import combine, labels, metrics, reports, reshape
from raterlake.plans import workload as W
from raterlake.plans.queries import _C, _R, query
from raterlake.plans.workload import table, with_ctes


@query(
    with_ctes(*_R)
    + """, l AS (SELECT user_id, fold, label, least(floor(prediction / 0.05::DOUBLE + 1e-9), 19) AS level FROM ratings), t AS (SELECT user_id, fold, i AS level FROM (SELECT DISTINCT user_id, fold FROM l), range(20) r(i)),
g AS (SELECT t.user_id, t.fold, t.level, 1.0::DOUBLE * count(*) FILTER (label = 1 AND l.level >= t.level) AS tp, 1.0::DOUBLE * count(*) FILTER (label = 0 AND l.level >= t.level) AS fp,
  1.0::DOUBLE * count(*) FILTER (label = 1 AND l.level < t.level) AS fn, 1.0::DOUBLE * count(*) FILTER (label = 0 AND l.level < t.level) AS tn FROM t JOIN l USING (user_id, fold) GROUP BY ALL),
x AS (SELECT user_id, fold, level, c AS class, round(coalesce(CASE WHEN c = 1 THEN 2 * tp / nullif(2 * tp + fp + fn, 0) ELSE 2 * tn / nullif(2 * tn + fp + fn, 0) END, 0), 9) AS f1,
  round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 9) AS b FROM g, (VALUES (1), (0)) v(c)),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, fold, class ORDER BY f1 DESC, level) AS k, row_number() OVER (PARTITION BY user_id, fold, class ORDER BY b DESC NULLS LAST, level) AS m FROM x)
SELECT user_id, fold, class, round(max(f1) FILTER (k = 1), 6) AS f1, round(max(level) FILTER (k = 1) * 0.05::DOUBLE, 6) AS f1_threshold,
  round(max(b) FILTER (m = 1), 6) AS balanced_accuracy, round(max(level) FILTER (m = 1) * 0.05::DOUBLE, 6) AS balanced_threshold FROM f GROUP BY user_id, fold, class"""
)
def best_f_by_round(spark, sf_dir):
    return metrics.best_f_by_class(W.ratings(spark, sf_dir), ["user_id", "fold"])


@query(
    with_ctes(*_R)
    + """, l AS (SELECT user_id, label, least(floor(prediction / 0.001::DOUBLE + 1e-9), 999) AS level FROM ratings), c AS (SELECT user_id, level, count(*) FILTER (label = 0) AS n, count(*) FILTER (label = 1) AS p FROM l GROUP BY ALL),
t AS (SELECT user_id, i AS level FROM (SELECT DISTINCT user_id FROM l), range(1000) r(i)), h AS (SELECT t.user_id, t.level, coalesce(n, 0) AS n, coalesce(p, 0) AS p FROM t LEFT JOIN c USING (user_id, level)),
g AS (SELECT user_id, level, sum(n) OVER w AS fp, sum(n) OVER a AS neg, sum(p) OVER w AS tp, sum(p) OVER a AS pos FROM h WINDOW w AS (PARTITION BY user_id ORDER BY level DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY user_id)),
e AS (SELECT user_id, level, fp / neg::DOUBLE AS fpr, (pos - tp) / pos::DOUBLE AS fnr FROM g)
SELECT user_id, round(min(level) * 0.001::DOUBLE, 6) AS eer_threshold, round(min_by((fpr + fnr) / 2, level), 6) AS eer FROM e WHERE fpr < fnr GROUP BY user_id"""
)
def equal_error_rates(spark, sf_dir):
    return metrics.equal_error_rate(W.ratings(spark, sf_dir), ["user_id"])


_LANG = ", d AS (SELECT lang, r.prediction FROM ratings r JOIN documents ON doc_id = item_id WHERE user_id = 'uniq.0' AND lang IS NOT NULL)"


@query(
    with_ctes(*_R)
    + _LANG
    + """, c AS (SELECT DISTINCT lang AS class FROM d), t AS (SELECT prediction, count(*) AS n FROM d GROUP BY 1),
x AS (SELECT class, t.prediction, t.n - coalesce(o.n, 0) AS others, coalesce(o.n, 0) AS own FROM t CROSS JOIN c LEFT JOIN (SELECT lang, prediction, count(*) AS n FROM d GROUP BY 1, 2) o ON o.lang = class AND o.prediction = t.prediction),
y AS (SELECT class, own, others, coalesce(sum(others) OVER (PARTITION BY class ORDER BY prediction ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM x),
z AS (SELECT class, sum(own * (below + others / 2.0)) / nullif(sum(own) * sum(others), 0) AS auc FROM y GROUP BY class)
SELECT class, round(auc, 6) AS auc, round(avg(auc) OVER (), 6) AS macro FROM z"""
)
def macro_auc(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang").filter("lang is not null")
    return metrics.macro_auc(W.ratings(spark, sf_dir).filter("user_id = 'uniq.0'").join(docs, "item_id"), "lang")


@query(
    with_ctes(*_R)
    + """, s AS (SELECT prediction, 1 - label AS label FROM ratings WHERE user_id = 'len.0'), b AS (SELECT min(prediction) AS lo, max(prediction) AS hi, sum(label) AS pos FROM s),
k AS (SELECT floor((prediction - lo) / ((hi - lo) / 1000) + 1e-9) + 1 AS k, label FROM s, b), c AS (SELECT k, sum(count(*)) OVER w AS n, sum(sum(label)) OVER w AS p FROM k GROUP BY k WINDOW w AS (ORDER BY k)),
f AS (SELECT k, round(2.0::DOUBLE * p / (n + pos), 9) AS f1, lo + k * (hi - lo) / 1000 AS epsilon FROM c, b WHERE k < 1000)
SELECT round(f1, 6) AS f1, round(epsilon, 6) AS epsilon FROM f ORDER BY f.f1 DESC, k LIMIT 1"""
)
def anomaly_thresholds(spark, sf_dir):
    scored = W.ratings(spark, sf_dir).filter("user_id = 'len.0'").withColumn("label", 1 - F.col("label"))
    return metrics.anomaly_threshold(scored)


@query(
    with_ctes(*_C)
    + """ SELECT user_id, count(DISTINCT color) AS n_values, count(DISTINCT color) = 2 AS is_binary, count(DISTINCT color) BETWEEN 2 AND 10 AS multivalued, bool_and(color IN (2, 1, -2, -1, 0)) AS coded,
  count(DISTINCT color) <= 2 AS label_prediction FROM colored GROUP BY user_id"""
)
def value_kinds(spark, sf_dir):
    return reports.value_kinds(W.colored(spark, sf_dir), ["user_id"], "color", [2, 1, -2, -1, 0])


@query(with_ctes(*_R) + " SELECT user_id, round(avg(prediction), 6) AS mean, round(var_pop(prediction), 6) AS variance, min(prediction) AS low, max(prediction) AS high FROM ratings GROUP BY user_id")
def feature_moments(spark, sf_dir):
    return reports.moments(W.ratings(spark, sf_dir), ["user_id"], "prediction")


@query(
    """WITH s AS (SELECT coalesce(source, '') AS source, count(*) AS n, round(avg(n_chars), 9) AS mean FROM documents GROUP BY 1)
SELECT source, n, round(mean, 6) AS mean, row_number() OVER (ORDER BY n DESC, source DESC) AS by_n, row_number() OVER (ORDER BY mean DESC, source DESC) AS by_mean FROM s"""
)
def bag_sizes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("")))
    out = reports.by_frequency(docs, "source", "n_chars")
    return out.withColumn("by_n", F.col("by_n").cast("long")).withColumn("by_mean", F.col("by_mean").cast("long"))


_BRIER = ", b AS (SELECT user_id, round(-avg((label - prediction) ** 2), 9) AS score, regexp_replace(user_id, '\\.[^.]*$', '') AS family FROM ratings GROUP BY user_id)"


def _brier(spark, sf_dir):
    score = F.round(-F.avg(F.pow(F.col("label") - F.col("prediction"), F.lit(2))), 9)
    return W.ratings(spark, sf_dir).groupBy("user_id").agg(score.alias("score")).withColumn("family", scalar.family(F.col("user_id")))


@query(with_ctes(*_R) + _BRIER + " SELECT user_id, round(score, 6) AS score, CAST(ntile(3) OVER (ORDER BY b.score DESC, user_id) AS INT) AS part FROM b")
def ranking_parts(spark, sf_dir):
    return reports.parts_of_ranking(_brier(spark, sf_dir), "score", "user_id", 3).select("user_id", "score", "part")


@query(with_ctes(*_R) + _BRIER + " SELECT 'sym' AS keyword, round(max(score), 6) AS best, round(min(score), 6) AS least, round(avg(score), 6) AS mean, round(median(score), 6) AS median FROM b WHERE contains(user_id, 'sym')")
def keyword_summary(spark, sf_dir):
    return reports.summarized(_brier(spark, sf_dir), "sym", "user_id", "score").select("keyword", "best", "least", "mean", "median")


@query(with_ctes(*_R) + _BRIER + """, m AS (SELECT family, round(avg(score), 9) AS mean, count(*) AS n FROM b GROUP BY family) SELECT family, round(mean, 6) AS mean, n, row_number() OVER (ORDER BY m.mean DESC, family) AS place FROM m QUALIFY place <= 3""")
def best_params(spark, sf_dir):
    return reports.best_params(_brier(spark, sf_dir), "family", "score", 3).withColumn("place", F.col("place").cast("long"))


@query(
    with_ctes(*_R)
    + _BRIER
    + """, x AS (SELECT max_by(user_id, (score, user_id)) AS m, max(score) AS s, min(score) AS l, family = 'sym' AS t FROM b WHERE family IN ('len', 'sym') GROUP BY family = 'sym')
SELECT a.m AS baseline, round(a.s, 6) AS baseline_score, t.m AS target, round(t.s, 6) AS target_score, t.s > a.s AS max_beats, t.s > a.s AS max_beats_all, t.l > a.s AS all_beat_all FROM x a, x t WHERE NOT a.t AND t.t"""
)
def baseline_report(spark, sf_dir):
    b = _brier(spark, sf_dir)
    return reports.report(b.filter("family = 'len'"), b.filter("family = 'sym'"), "user_id", "score")


@query(
    with_ctes(*_C, "majority")
    + """, p AS (SELECT user_id, avg(CAST(label = vote AS INT)) AS a, 2.0::DOUBLE * count(*) FILTER (label = 1 AND vote = 1) AS t2, count(*) FILTER (label <> vote) AS w, count(*) FILTER (label = 1 AND vote = 1) AS tp, count(*) FILTER (label = 0 AND vote = 0) AS tn FROM colored GROUP BY 1),
q AS (SELECT user_id, avg(CAST(c.label = majority AS INT)) AS a, 2.0::DOUBLE * count(*) FILTER (c.label = 1 AND majority = 1) AS t2, count(*) FILTER (c.label <> majority) AS w, count(*) FILTER (c.label = 1 AND majority = 1) AS tp, count(*) FILTER (c.label = 0 AND majority = 0) AS tn FROM colored c JOIN majority m USING (item_id) GROUP BY 1)
SELECT user_id, round(p.a, 6) AS prior_accuracy, round(q.a, 6) AS posterior_accuracy, round(p.t2 / nullif(p.t2 + p.w, 0), 6) AS prior_f1, round(q.t2 / nullif(q.t2 + q.w, 0), 6) AS posterior_f1, q.tp - p.tp AS more_tp, q.tn - p.tn AS more_tn
FROM p JOIN q USING (user_id)"""
)
def prior_and_posterior(spark, sf_dir):
    """Each rater's own votes against the majority's."""
    v = labels.agreeing_with_majority(W.voted(spark, sf_dir))
    before = metrics.label_metrics(metrics.confusion(v, ["user_id"]))
    after = metrics.label_metrics(metrics.confusion(v.withColumn("vote", F.col("majority")), ["user_id"]))
    return reports.compared(before, after, ["user_id"])


@query(
    with_ctes(*_C)
    + """, n AS (SELECT item_id, color, count(*) AS n, min(user_id) AS first_at FROM colored WHERE prediction > 0 GROUP BY item_id, color)
SELECT item_id, color AS mode, first_at, n AS mode_n FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first_at) AS k FROM n) WHERE k = 1"""
)
def conditional_modes(spark, sf_dir):
    return reports.modes_in_order(W.colored(spark, sf_dir), ["item_id"], "color", "user_id", F.col("prediction") > 0)


@query("""WITH w AS (SELECT unnest(string_split(coalesce(text, ''), ' ')) AS word FROM documents) SELECT word, count(*) AS count FROM w WHERE word <> '' GROUP BY word ORDER BY count, word LIMIT 20""")
def rarest_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word")).filter("word <> ''")
    return reports.rarest(words, "word", 20)


@query(with_ctes(*_C) + " SELECT color, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, color) AS place FROM colored GROUP BY color")
def colors_by_count(spark, sf_dir):
    counts = W.colored(spark, sf_dir).groupBy("color").agg(F.count("*").alias("n"))
    return combine.places(counts, "n", "color")


@query(with_ctes(*_R) + " SELECT user_id, item_id, label AS rating, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS split FROM ratings")
def label_matrix(spark, sf_dir):
    return reshape.label_matrix(reshape.split_at(W.ratings(spark, sf_dir), 0))


@query(
    with_ctes(*_R)
    + """, f AS (SELECT user_id, min(prediction) AS lo, max(prediction) AS hi FROM ratings WHERE fold <> 0 GROUP BY user_id)
SELECT user_id, item_id, round(coalesce((prediction - lo) / nullif(hi - lo, 0), 0), 6) AS scaled FROM ratings JOIN f USING (user_id) WHERE fold = 0"""
)
def fitted_scaling(spark, sf_dir):
    r = reshape.split_at(W.ratings(spark, sf_dir), 0)
    return combine.scaled_by(r.filter("split = 'test'"), r.filter("split = 'train'")).select("user_id", "item_id", "scaled")


@query("SELECT doc_id, CAST(lang = 'en' AS INT) AS is_target, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INT) AS code FROM documents WHERE lang IS NOT NULL")
def class_codes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").filter("lang is not null")
    return reshape.class_codes(docs, "lang", "en").select("doc_id", "is_target", "code")


@query(
    with_ctes(*_R)
    + """ SELECT item_id, fold, starts_with(user_id, 'u') AND fold % 2 = 0 AS user_dim, CAST(ceil(greatest(fold, 1) * 10 * 0.25::DOUBLE) AS INT) AS quarter, least(fold + 3, 5) AS at_most, prediction - 1.0::DOUBLE AS shifted,
  CASE WHEN prediction < 0.2 THEN 'below' WHEN prediction > 0.8 THEN 'above' ELSE 'within' END AS scope, CASE WHEN label = 1 THEN 1 ELSE -1 END AS polarity, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS preference,
  CASE WHEN prediction >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hard, regexp_replace(user_id, '\\.[^.]*$', '') || '_' || CAST(fold AS VARCHAR) AS joined_key, '"' || user_id || '","' || CAST(fold AS VARCHAR) || '"' AS quoted,
  TRY_CAST(regexp_extract(user_id, '[^.]*$') AS DOUBLE) AS bag_number FROM ratings"""
)
def code_functions(spark, sf_dir):
    r = W.ratings(spark, sf_dir)
    p, u = F.col("prediction"), F.col("user_id")
    parts = F.array(scalar.family(u), F.col("fold").cast("string"))
    return r.select(
        "item_id",
        "fold",
        scalar.is_user_dim(u, F.col("fold")).alias("user_dim"),
        scalar.select_k(F.greatest("fold", F.lit(1)) * 10, 0.25).alias("quarter"),
        scalar.select_k(F.col("fold") + 3, 5).alias("at_most"),
        (p - 1.0).alias("shifted"),
        scalar.scope(p, 0.2, 0.8).alias("scope"),
        scalar.preference_to_polarity(F.col("label")).alias("polarity"),
        scalar.polarity_to_preference(scalar.preference_to_polarity(F.col("label"))).alias("preference"),
        scalar.binarize(p, F.lit(0.5)).alias("hard"),
        arrays.key_of(parts).alias("joined_key"),
        arrays.quoted(F.array(u, F.col("fold").cast("string"))).alias("quoted"),
        scalar.coerce_number(F.element_at(F.split(u, r"\."), -1)).alias("bag_number"),
    )


_VEC = ", v AS (SELECT item_id, list(prediction ORDER BY user_id) AS x, list(label + prediction * prediction ORDER BY user_id) AS y FROM ratings GROUP BY item_id)"


@query(
    with_ctes(*_R)
    + _VEC
    + """ SELECT item_id, round(sqrt(greatest(list_sum([(a - b) ** 2 for a, b in x]), 1e-7)), 6) AS euclidean, round(sqrt(list_sum([a * a for a in x])), 6) AS norm,
  round(exp(x[1] - list_max(x)) / list_sum([exp(a - list_max(x)) for a in x]), 6) AS softmax_first, len(x) - 2 AS left_over, len(x) - 1 AS bigrams FROM v""".replace("[(a - b) ** 2 for a, b in x]", "list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) ** 2)").replace("[a * a for a in x]", "list_transform(x, lambda a: a * a)").replace("[exp(a - list_max(x)) for a in x]", "list_transform(x, lambda a: exp(a - list_max(x)))")
)
def array_functions(spark, sf_dir):
    both = F.array_sort(F.collect_list(F.struct("user_id", "prediction", (F.col("label") + F.col("prediction") * F.col("prediction")).alias("y"))))
    v = W.ratings(spark, sf_dir).groupBy("item_id").agg(both.alias("c")).select("item_id", F.transform("c", lambda z: z["prediction"]).alias("x"), F.transform("c", lambda z: z["y"]).alias("y"))
    x, y = F.col("x"), F.col("y")
    return v.select(
        "item_id",
        arrays.euclidean(x, y).alias("euclidean"),
        arrays.norm(x).alias("norm"),
        F.get(arrays.softmax(x), F.lit(0)).alias("softmax_first"),
        F.size(arrays.without_positions(x, F.array(F.lit(0), F.lit(3)))).alias("left_over"),
        F.size(arrays.ngrams(F.transform(x, lambda z: z.cast("string")), 2)).alias("bigrams"),
    )
