"""Registered queries of the reference's operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raterlake.functions import arrays, scalar
from raterlake.operators import cluster, combine, confidence, factors, labels, metrics, ngrams, reshape, sampling, selection, similarity, topk
from raterlake.operators.state import stored
from raterlake.plans import workload as W
from raterlake.plans.workload import table, with_ctes
from raterlake.streaming import scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, small integers as they are; -0.0 as 0.0."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes))


def query(sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Registers a query. Means of scores of six digits are rounded to more, as they can lie half-way between two of six."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_R = ("base", "ratings")
_V = (*_R, "curve", "fmax", "voted")
_C = (*_V, "colored")


@query(
    with_ctes(*_V, "majority")
    + """, c AS (SELECT sum(CAST(label = 1 AND majority = 1 AS INT)) AS tp, sum(CAST(label = 0 AND majority = 0 AS INT)) AS tn,
  sum(CAST(label = 0 AND majority = 1 AS INT)) AS fp, sum(CAST(label = 1 AND majority = 0 AS INT)) AS fn FROM majority)
SELECT CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
  round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c"""
)
def flagship(spark, sf_dir):
    """Thresholds by F-max, votes, majority labels, and their quality."""
    v = W.voted(spark, sf_dir)
    m = labels.majority(v).join(v.groupBy("item_id").agg(F.max("label").alias("label")), "item_id").withColumnRenamed("majority", "vote")
    return metrics.label_metrics(metrics.confusion(m, [])).select("tp", "tn", "fp", "fn", "accuracy", "f1", "balanced_accuracy")


@query(with_ctes(*_R) + " SELECT user_id, item_id, prediction, label, fold, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN CAST(prediction >= 0.5 AS INT) <> label THEN -1.0 ELSE prediction END AS rating FROM ratings")
def rating_matrix(spark, sf_dir):
    return reshape.masked_ratings(reshape.split_at(W.ratings(spark, sf_dir), 0))


@query(with_ctes(*_R) + " SELECT item_id, label, " + ", ".join(f"max(prediction) FILTER (user_id = '{u}') AS {u.replace('.', '_')}" for u in W.USERS) + " FROM ratings GROUP BY item_id, label")
def wide_level1(spark, sf_dir):
    wide = reshape.to_wide(W.ratings(spark, sf_dir), W.USERS)
    return wide.withColumnsRenamed({u: u.replace(".", "_") for u in W.USERS})


@query(with_ctes(*_R) + " SELECT user_id, item_id, prediction, label FROM ratings")
def wide_to_long(spark, sf_dir):
    return reshape.to_long(reshape.to_wide(W.ratings(spark, sf_dir), W.USERS), ["item_id", "label"]).select("user_id", "item_id", "prediction", "label")


@query(with_ctes(*_R) + " SELECT user_id, item_idx, prediction FROM (SELECT user_id, prediction, row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1 AS item_idx FROM ratings)")
def array_round_trip(spark, sf_dir):
    return reshape.from_arrays(reshape.to_arrays(W.ratings(spark, sf_dir))).withColumn("item_idx", F.col("item_idx").cast("long"))


@query(with_ctes(*_R) + " SELECT user_id, item_id, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS BIGINT) AS user_idx, CAST(dense_rank() OVER (ORDER BY item_id) - 1 AS BIGINT) AS item_idx FROM ratings")
def indexed_ratings(spark, sf_dir):
    return reshape.with_indices(W.ratings(spark, sf_dir)).select("user_id", "item_id", "user_idx", "item_idx")


@query(with_ctes(*_R) + " SELECT item_id, CAST(count(DISTINCT label) AS BIGINT) AS labels FROM ratings GROUP BY item_id HAVING count(DISTINCT label) > 1")
def label_disagreements(spark, sf_dir):
    return reshape.label_agreement(W.ratings(spark, sf_dir))


@query(with_ctes(*_R, "curve", "fmax") + " SELECT user_id, threshold, round(f, 6) AS fmax, round(tp / n_pred, 6) AS precision, round(tp / n_pos, 6) AS recall FROM fmax")
def fmax_thresholds(spark, sf_dir):
    return metrics.fmax(W.ratings(spark, sf_dir), ["user_id"])


def _policy_sql(name: str, score: str) -> str:
    return with_ctes(*_R, "curve") + f""" SELECT user_id, threshold, round(s, 6) + 0.0 AS {name} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, threshold) AS k FROM (SELECT *, round({score}, 9) AS s FROM curve)) WHERE k = 1"""


@query(_policy_sql("balanced_accuracy", "(tp / n_pos + 1 - fp / n_neg) / 2"))
def balanced_thresholds(spark, sf_dir):
    return metrics.balanced_threshold(W.ratings(spark, sf_dir), ["user_id"])


@query(_policy_sql("youden", "tp / n_pos - fp / n_neg"))
def youden_thresholds(spark, sf_dir):
    return metrics.youden_threshold(W.ratings(spark, sf_dir), ["user_id"])


@query(_policy_sql("closeness", "-abs(tp / n_pos - (1 - fp / n_neg))"))
def equal_rate_thresholds(spark, sf_dir):
    return metrics.equal_rate_threshold(W.ratings(spark, sf_dir), ["user_id"])


@query(with_ctes(*_R) + " SELECT user_id, min(prediction) AS threshold FROM (SELECT user_id, prediction, row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS k, sum(label) OVER (PARTITION BY user_id) AS n_pos FROM ratings) WHERE k <= n_pos GROUP BY user_id")
def prior_thresholds(spark, sf_dir):
    return metrics.prior_threshold(W.ratings(spark, sf_dir), ["user_id"])


@query(with_ctes(*_R, "curve") + """ SELECT user_id, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(n_pos - tp AS BIGINT) AS fn, CAST(n_neg - fp AS BIGINT) AS tn
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY threshold DESC) AS k FROM curve WHERE fp / n_neg >= 0.1) WHERE k = 1""")
def fpr_confusions(spark, sf_dir):
    return metrics.fpr_confusion(W.ratings(spark, sf_dir), ["user_id"])


@query(with_ctes(*_R, "curve", "fmax", "voted") + """,
area AS (SELECT user_id, (fp - coalesce(lag(fp) OVER w, 0)) * (tp + coalesce(lag(tp) OVER w, 0)) / 2.0::DOUBLE AS a, n_pos, n_neg FROM curve WINDOW w AS (PARTITION BY user_id ORDER BY threshold DESC)),
aucs AS (SELECT user_id, sum(a) / max(n_pos * n_neg) AS auc FROM area GROUP BY user_id),
l AS (SELECT user_id, avg((label - prediction) ** 2) AS brier_loss, -avg(label * ln(least(greatest(prediction, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(prediction, 1e-15), 1 - 1e-15))) AS log_loss, avg(label) AS rate FROM ratings GROUP BY user_id),
c AS (SELECT user_id, sum(CAST(color = 2 AS INT))::DOUBLE AS tp, sum(CAST(color = 1 AS INT))::DOUBLE AS tn, sum(CAST(color = -2 AS INT))::DOUBLE AS fp, sum(CAST(color = -1 AS INT))::DOUBLE AS fn
  FROM (SELECT user_id, CASE WHEN label = 1 AND vote = 1 THEN 2 WHEN label = 0 AND vote = 0 THEN 1 WHEN label = 0 AND vote = 1 THEN -2 ELSE -1 END AS color FROM voted) GROUP BY user_id)
SELECT user_id, round(auc, 6) AS auc, round(f.f, 6) AS fmax, round(brier_loss, 6) AS brier_loss, round(log_loss, 6) AS log_loss, round(1 - brier_loss / (rate * (1 - rate)), 6) AS brier_skill, round(sqrt(brier_loss), 6) AS rmse,
  round((c.tp + c.tn) / (c.tp + c.tn + c.fp + c.fn), 6) AS accuracy, round(c.tp / (c.tp + c.fp), 6) AS precision, round(c.tp / (c.tp + c.fn), 6) AS recall, round(c.tn / (c.tn + c.fp), 6) AS specificity,
  CASE WHEN c.tn + c.fn > 0 THEN round(c.tn / (c.tn + c.fn), 6) END AS npv, round(2 * c.tp / (2 * c.tp + c.fp + c.fn), 6) AS f1, round(5 * c.tp / (5 * c.tp + c.fp + 4 * c.fn), 6) AS f2, round((c.tp / (c.tp + c.fn) + c.tn / (c.tn + c.fp)) / 2, 6) AS balanced_accuracy,
  CASE WHEN (c.tp + c.fp) * (c.tp + c.fn) * (c.tn + c.fp) * (c.tn + c.fn) > 0 THEN round((c.tp * c.tn - c.fp * c.fn) / sqrt((c.tp + c.fp) * (c.tp + c.fn) * (c.tn + c.fp) * (c.tn + c.fn)), 6) END AS mcc
FROM aucs JOIN fmax f USING (user_id) JOIN l USING (user_id) JOIN c USING (user_id)""")
def rater_performance(spark, sf_dir):
    return metrics.performance(W.ratings(spark, sf_dir), ["user_id"]).select(
        "user_id", "auc", "fmax", "brier_loss", "log_loss", "brier_skill", "rmse", "accuracy", "precision", "recall", "specificity", "npv", "f1", "f2", "balanced_accuracy", "mcc"
    )


@query(with_ctes(*_R) + """, t AS (SELECT unnest(range(20)) AS level)
SELECT user_id, round(level * 0.05::DOUBLE, 6) AS threshold, CAST(sum(CAST(l >= level AND label = 1 AS INT)) AS BIGINT) AS tp, CAST(sum(CAST(l < level AND label = 0 AS INT)) AS BIGINT) AS tn,
  CAST(sum(CAST(l >= level AND label = 0 AS INT)) AS BIGINT) AS fp, CAST(sum(CAST(l < level AND label = 1 AS INT)) AS BIGINT) AS fn
FROM (SELECT user_id, label, least(floor(prediction / 0.05::DOUBLE + 1e-9::DOUBLE), 19) AS l FROM ratings), t GROUP BY user_id, level""")
def grid_confusions(spark, sf_dir):
    return metrics.grid(W.ratings(spark, sf_dir), ["user_id"])


@query(with_ctes(*_C) + " SELECT user_id, item_id, vote, color, polarity, reliable, reduced_color FROM colored")
def cell_colors(spark, sf_dir):
    return W.colored(spark, sf_dir).select("user_id", "item_id", "vote", "color", "polarity", "reliable", "reduced_color")


@query(with_ctes(*_C) + """ SELECT u.user_id, k.color, CAST(count(c.color) AS BIGINT) AS n FROM (SELECT DISTINCT user_id FROM colored) u CROSS JOIN (SELECT unnest([2, 1, -2, -1, 0]) AS color) k
LEFT JOIN colored c ON c.user_id = u.user_id AND c.color = k.color GROUP BY u.user_id, k.color""")
def color_counts(spark, sf_dir):
    return labels.color_counts(W.colored(spark, sf_dir), ["user_id"])


@query(with_ctes(*_C) + " SELECT item_id, CAST(2 AS INT) AS labels FROM colored GROUP BY item_id HAVING count(DISTINCT CASE WHEN color IN (2, -1) THEN 1 ELSE 0 END) > 1")
def color_violations(spark, sf_dir):
    return labels.color_violations(W.colored(spark, sf_dir))


@query(with_ctes(*_C) + " SELECT item_id, max(label) AS label FROM colored GROUP BY item_id")
def labels_from_colors(spark, sf_dir):
    return labels.labels_from_colors(W.colored(spark, sf_dir))


@query(with_ctes(*_V, "majority") + " SELECT item_id, majority FROM majority")
def majority_labels(spark, sf_dir):
    return labels.majority(W.voted(spark, sf_dir))


@query(with_ctes(*_V, "majority") + " SELECT user_id, item_id, majority, CAST(vote = majority AS INT) AS agrees FROM voted JOIN majority USING (item_id)")
def majority_filter(spark, sf_dir):
    return labels.agreeing_with_majority(W.voted(spark, sf_dir)).select("user_id", "item_id", "majority", "agrees")


@query(with_ctes(*_C) + " SELECT user_id, item_id, CASE WHEN color IN (-2, -1) THEN 0.0 ELSE prediction END AS masked FROM colored")
def masked_errors(spark, sf_dir):
    return labels.mask_color(W.colored(spark, sf_dir), [-2, -1]).select("user_id", "item_id", "masked")


@query(with_ctes(*_R) + """ SELECT user_id, item_id, CAST(h <= 10 OR l <= 10 AS INT) AS extreme FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS h,
  row_number() OVER (PARTITION BY user_id ORDER BY prediction, item_id) AS l FROM ratings)""")
def extreme_cells(spark, sf_dir):
    return labels.extreme_cells(W.ratings(spark, sf_dir), 10).select("user_id", "item_id", "extreme")


@query(with_ctes(*_C) + """ SELECT user_id, item_id, CASE WHEN reliable = 1 AND k <= greatest(floor(n * 0.5), 1) THEN 1 WHEN reliable = 0 THEN -1 ELSE 0 END AS kept FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, reliable ORDER BY abs(prediction - p_th) DESC, user_id) AS k, count(*) OVER (PARTITION BY item_id) AS n FROM colored)""")
def kept_correct_cells(spark, sf_dir):
    return labels.kept_correct_cells(W.colored(spark, sf_dir)).select("user_id", "item_id", "kept")


@query(with_ctes(*_V) + """ SELECT pattern, CAST(count(*) AS BIGINT) AS n, round(avg(label), 6) AS probability FROM (
  SELECT item_id, string_agg(CAST(vote AS VARCHAR), '' ORDER BY user_id) AS pattern, max(label) AS label FROM voted GROUP BY item_id) GROUP BY pattern""")
def vote_patterns(spark, sf_dir):
    return labels.vote_pattern_probability(W.voted(spark, sf_dir))


@query("""WITH c AS (SELECT lang, count(*) AS n, sum(1 - quality) AS n_pos FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, CAST(n AS BIGINT) AS n, CAST(n_pos AS BIGINT) AS n_pos, CAST(n - n_pos AS BIGINT) AS n_neg, round(n_pos / n, 6) AS prior, CASE WHEN n_pos <= n - n_pos THEN 1 ELSE 0 END AS min_class,
  round(least(n_pos, n - n_pos) / n, 6) AS min_ratio, CASE WHEN least(n_pos, n - n_pos) > 0 THEN round(greatest(n_pos, n - n_pos) / least(n_pos, n - n_pos), 6) END AS multiple, least(n_pos, n - n_pos) / n >= 0.1 AS balanced FROM c""")
def class_priors(spark, sf_dir):
    items = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (1 - F.col("quality")).cast("long").alias("label"))
    return labels.class_prior(items, ["lang"])


@query(with_ctes(*_V, "majority", "colored") + """, c AS (SELECT user_id, sum(CAST(m = vote AND color > 0 AS INT))::DOUBLE AS r, sum(CAST(m = vote AND color < 0 AS INT))::DOUBLE AS w,
  sum(CAST(m <> vote AND color > 0 AS INT))::DOUBLE AS lr, sum(CAST(m <> vote AND color < 0 AS INT))::DOUBLE AS lw FROM (SELECT c.*, majority AS m FROM colored c JOIN majority USING (item_id)) GROUP BY user_id)
SELECT user_id, CAST(r AS BIGINT) AS kept_right, CAST(w AS BIGINT) AS kept_wrong, CAST(lr AS BIGINT) AS lost_right, CAST(lw AS BIGINT) AS lost_wrong,
  CASE WHEN r + w > 0 THEN round(r / (r + w), 6) END AS filter_precision, CASE WHEN r + lr > 0 THEN round(r / (r + lr), 6) END AS filter_recall,
  round((w + lr) / (r + w + lr + lw), 6) AS filter_error, round(ln((r + lw + 1) / (w + lr + 1)), 6) AS hit_to_miss FROM c""")
def filter_quality(spark, sf_dir):
    agreed = labels.agreeing_with_majority(W.voted(spark, sf_dir))
    return labels.filter_quality(labels.colored(agreed), F.col("agrees"), ["user_id"])


@query(with_ctes(*_R) + """ SELECT item_id, round(avg(prediction), 6) AS mean, round(median(prediction), 6) AS median, round(sum(prediction), 6) AS total, min(prediction) AS low, max(prediction) AS high, max(label) AS label FROM ratings GROUP BY item_id""")
def combined_scores(spark, sf_dir):
    return combine.combine(W.ratings(spark, sf_dir))


@query(with_ctes(*_R) + """, u AS (SELECT split_part(user_id, '.', 1) AS user_id, item_id, avg(prediction) AS prediction, max(label) AS label FROM ratings GROUP BY 1, 2)
SELECT item_id, round(avg(prediction), 10) AS mean, round(median(prediction), 10) AS median FROM u GROUP BY item_id""", digits=10)
def unbagged_means(spark, sf_dir):
    return combine.combine(combine.unbag(W.ratings(spark, sf_dir))).select("item_id", "mean", "median")


@query(with_ctes(*_R) + " SELECT split_part(user_id, '.', 1) AS family, CAST(count(DISTINCT user_id) AS BIGINT) AS bags FROM ratings GROUP BY 1")
def bag_counts(spark, sf_dir):
    return combine.bag_counts(W.ratings(spark, sf_dir))


@query(with_ctes(*_R) + " SELECT user_id, item_id, prediction FROM ratings WHERE user_id LIKE '%.0'")
def first_bags(spark, sf_dir):
    return combine.first_bags(W.ratings(spark, sf_dir), 1).select("user_id", "item_id", "prediction")


@query(with_ctes(*_C) + """ SELECT item_id, round(coalesce(avg(prediction) FILTER (reliable <> 0), avg(prediction)), 6) AS mean, CAST(sum(reliable) AS BIGINT) AS kept, max(label) AS label FROM colored GROUP BY item_id""")
def reliable_means(spark, sf_dir):
    return combine.combine_reliable(W.colored(spark, sf_dir))


@query(with_ctes(*_C) + """, w AS (SELECT user_id, 1 - avg((label - prediction) ** 2) AS w_brier FROM colored GROUP BY user_id), i AS (SELECT item_id, avg(reliable) AS w_item FROM colored GROUP BY item_id),
x AS (SELECT c.item_id, c.prediction, c.label, w_brier * w_item AS c0 FROM colored c JOIN w USING (user_id) JOIN i USING (item_id))
SELECT item_id, round(CASE WHEN sum(c0) > 0 THEN sum(c0 * prediction) / sum(c0) ELSE avg(prediction) END, 6) AS weighted, max(label) AS label FROM x GROUP BY item_id""")
def confidence_weighted(spark, sf_dir):
    return combine.weighted(confidence.cell_confidence(W.colored(spark, sf_dir)), "c0")


@query(with_ctes(*_C) + """, w AS (SELECT user_id, 1 - avg((label - prediction) ** 2) AS w_brier FROM colored GROUP BY user_id), x AS (SELECT item_id, prediction, exp(w_brier) AS e FROM colored JOIN w USING (user_id))
SELECT item_id, round(sum(e * prediction) / sum(e), 6) AS softmax_mean FROM x GROUP BY item_id""")
def softmax_means(spark, sf_dir):
    c = W.colored(spark, sf_dir)
    return combine.softmax_weighted(c.join(F.broadcast(confidence.user_confidence(c).select("user_id", "w_brier")), "user_id"), "w_brier")


@query(with_ctes(*_C) + """ SELECT user_id, item_id, round(CASE WHEN reliable <> 0 THEN prediction ELSE coalesce(avg(CASE WHEN reliable <> 0 THEN prediction END) OVER (PARTITION BY item_id), avg(prediction) OVER (PARTITION BY item_id)) END, 10) AS filled FROM colored""", digits=10)
def filled_cells(spark, sf_dir):
    return combine.fill_masked(W.colored(spark, sf_dir)).select("user_id", "item_id", "filled")


@query(with_ctes(*_R) + """ SELECT user_id, item_id, round(prediction - avg(prediction) OVER u, 6) + 0.0 AS centered, round(CASE WHEN max(prediction) OVER u > min(prediction) OVER u THEN (prediction - min(prediction) OVER u) / (max(prediction) OVER u - min(prediction) OVER u) ELSE 0 END, 6) AS scaled,
  round(CASE WHEN sum(prediction * prediction) OVER u > 0 THEN prediction / sqrt(sum(prediction * prediction) OVER u) ELSE prediction END, 6) AS normalized FROM ratings WINDOW u AS (PARTITION BY user_id)""")
def normalized_scores(spark, sf_dir):
    return combine.unit_length(combine.scaled(combine.centered(W.ratings(spark, sf_dir)), ["user_id"])).select("user_id", "item_id", "centered", "scaled", "normalized")


@query("""SELECT event_type, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM events GROUP BY event_type""")
def five_numbers(spark, sf_dir):
    return combine.five_numbers(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""WITH e AS (SELECT event_type, value AS v, sum(1 + user_id % 3) AS w FROM events GROUP BY event_type, value),
c AS (SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY v) AS cum, sum(w) OVER (PARTITION BY event_type) / 2.0::DOUBLE AS half, lead(v) OVER (PARTITION BY event_type ORDER BY v) AS nxt FROM e)
SELECT event_type, round(CASE WHEN cum = half THEN coalesce((v + nxt) / 2, v) ELSE v END, 6) AS weighted_median FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) AS k FROM c WHERE cum >= half) WHERE k = 1""")
def weighted_medians(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("w", 1 + F.pmod("user_id", F.lit(3)))
    return combine.weighted_median(events, ["event_type"], "value", "w")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS mode, CAST(n AS BIGINT) AS mode_n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) WHERE k = 1""")
def modes(spark, sf_dir):
    return combine.mode(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""WITH p AS (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type)
SELECT user_id, round(-sum(p * log2(p)), 6) + 0.0 AS entropy, round(1 - sum(p * p), 6) AS gini FROM p GROUP BY user_id""")
def entropies(spark, sf_dir):
    return combine.entropy(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""WITH d AS (SELECT lang, quality FROM documents JOIN labels USING (doc_id)), h AS (SELECT -sum(p * log2(p)) AS total FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM d GROUP BY quality)),
l AS (SELECT lang, sum(n) AS n, -sum(n / t * log2(n / t)) AS e FROM (SELECT lang, quality, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS t FROM d GROUP BY 1, 2) GROUP BY lang)
SELECT round(total, 6) AS total, round(rest, 6) AS rest, round(total - rest, 6) AS gain FROM h, (SELECT sum(e * n) / sum(n) AS rest FROM l)""")
def information_gains(spark, sf_dir):
    return combine.information_gain(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), "quality", "lang")


@query(with_ctes(*_C) + """ SELECT user_id, round(1 - avg((label - prediction) ** 2), 6) AS w_brier, round(avg(reliable), 6) AS w_ratio,
  CASE WHEN stddev_pop(prediction) * stddev_pop(label) > 0 THEN round((avg(label * prediction) - avg(label) * avg(prediction)) / (stddev_pop(prediction) * stddev_pop(label)), 6) END AS w_corr FROM colored GROUP BY user_id""")
def user_confidence(spark, sf_dir):
    return confidence.user_confidence(W.colored(spark, sf_dir))


@query(with_ctes(*_C) + """, w AS (SELECT user_id, 1 - avg((label - prediction) ** 2) AS w_brier FROM colored GROUP BY user_id), i AS (SELECT item_id, avg(reliable) AS w_item FROM colored GROUP BY item_id),
n AS (SELECT color, 1.0::DOUBLE / count(*) AS v FROM colored GROUP BY color), k AS (SELECT color, v / sum(v) OVER () AS weight FROM n)
SELECT user_id, item_id, round(w_brier * w_item, 6) AS c0, round(10 * weight * w_brier * w_item, 6) AS cw, round(CASE WHEN color > 0 THEN 10 * weight * w_brier * w_item ELSE 0 END, 6) AS cn
FROM colored JOIN w USING (user_id) JOIN i USING (item_id) JOIN k USING (color)""")
def cell_confidence(spark, sf_dir):
    return confidence.balanced(confidence.cell_confidence(W.colored(spark, sf_dir))).select("user_id", "item_id", "c0", "cw", "cn")


@query(with_ctes(*_R) + " SELECT user_id, item_id, round(rank() OVER (PARTITION BY user_id ORDER BY prediction) + (count(*) OVER (PARTITION BY user_id, prediction) - 1) / 2.0::DOUBLE, 6) AS average_rank FROM ratings")
def average_ranks(spark, sf_dir):
    return confidence.average_ranks(W.ratings(spark, sf_dir)).select("user_id", "item_id", "average_rank")


@query(with_ctes(*_V) + """, q AS (SELECT user_id, vote, quantile_cont(prediction, 0.25) AS q1, quantile_cont(prediction, 0.75) AS q3 FROM voted GROUP BY user_id, vote)
SELECT user_id, vote, round(q1, 10) AS q1, round(q3, 10) AS q3, round(q1 - 1.5 * (q3 - q1), 10) + 0.0 AS lower, round(q3 + 1.5 * (q3 - q1), 10) AS upper FROM q""", digits=10)
def outlier_bounds(spark, sf_dir):
    return confidence.outlier_bounds(W.voted(spark, sf_dir))


@query(with_ctes(*_C) + " SELECT item_id, string_agg(CAST(reliable AS VARCHAR), ',' ORDER BY user_id) AS filter, string_agg(user_id, ',' ORDER BY user_id) AS users FROM colored GROUP BY item_id")
def filter_sequences(spark, sf_dir):
    s = confidence.item_sequences(W.colored(spark, sf_dir), "reliable")
    return s.select("item_id", F.array_join(F.transform("reliables", lambda x: x.cast("string")), ",").alias("filter"), F.array_join("user_ids", ",").alias("users"))


@query(with_ctes(*_R) + """ SELECT a.user_id AS a, b.user_id AS b, round(sum(a.prediction * b.prediction) / greatest(sqrt(sum(a.prediction * a.prediction)) * sqrt(sum(b.prediction * b.prediction)), 1e-9), 6) AS similarity
FROM ratings a JOIN ratings b USING (item_id) GROUP BY 1, 2""")
def rater_cosine(spark, sf_dir):
    return similarity.cosine(W.ratings(spark, sf_dir))


@query(with_ctes(*_R) + """ SELECT a.user_id AS a, b.user_id AS b, round((avg(a.prediction * b.prediction) - avg(a.prediction) * avg(b.prediction)) / (stddev_pop(a.prediction) * stddev_pop(b.prediction)), 6) AS correlation
FROM ratings a JOIN ratings b USING (item_id) GROUP BY 1, 2""")
def rater_pearson(spark, sf_dir):
    return similarity.pearson(W.ratings(spark, sf_dir)).select("a", "b", "correlation")


@query(with_ctes(*_R) + """, p AS (SELECT a.user_id AS a, b.user_id AS b, (avg(a.prediction * b.prediction) - avg(a.prediction) * avg(b.prediction)) / (stddev_pop(a.prediction) * stddev_pop(b.prediction)) AS c
FROM ratings a JOIN ratings b ON a.item_id = b.item_id AND a.user_id < b.user_id GROUP BY 1, 2) SELECT round(avg(abs(c)), 6) AS average_pearson, CAST(count(*) AS BIGINT) AS pairs FROM p""")
def diversity(spark, sf_dir):
    return similarity.diversity(W.ratings(spark, sf_dir))


_SIM = """, s AS (SELECT a.user_id AS a, b.user_id AS b, round(sum(a.prediction * b.prediction) / greatest(sqrt(sum(a.prediction * a.prediction)) * sqrt(sum(b.prediction * b.prediction)), 1e-9), 6) AS similarity FROM ratings a JOIN ratings b USING (item_id) GROUP BY 1, 2),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS k FROM s) WHERE k <= 3)"""


@query(with_ctes(*_R) + _SIM + " SELECT n.a AS user_id, r.item_id, round(sum(similarity * prediction) / sum(abs(similarity)), 6) AS predicted FROM n JOIN ratings r ON r.user_id = n.b GROUP BY 1, 2")
def neighbor_prediction(spark, sf_dir):
    r = W.ratings(spark, sf_dir)
    return similarity.predict_topk(r, rounded(similarity.cosine(r)))


@query(with_ctes(*_R) + _SIM + """, m AS (SELECT user_id, avg(prediction) AS mean FROM ratings GROUP BY user_id)
SELECT n.a AS user_id, r.item_id, round(max(o.mean) + sum(similarity * (prediction - m.mean)) / sum(abs(similarity)), 6) + 0.0 AS predicted FROM n JOIN ratings r ON r.user_id = n.b JOIN m ON m.user_id = n.b JOIN m o ON o.user_id = n.a GROUP BY 1, 2""")
def debiased_prediction(spark, sf_dir):
    r = W.ratings(spark, sf_dir)
    return similarity.predict_topk(r, rounded(similarity.cosine(r)), debiased=True)


@query(with_ctes(*_R) + """, w AS (SELECT user_id, (avg(label * prediction) - avg(label) * avg(prediction)) / (stddev_pop(label) * stddev_pop(prediction)) AS rho FROM ratings GROUP BY user_id)
SELECT item_id, round(sum(rho * prediction) / sum(abs(rho)), 6) + 0.0 AS score FROM ratings JOIN w USING (user_id) GROUP BY item_id""")
def correlation_prediction(spark, sf_dir):
    return similarity.predict_by_label_correlation(W.ratings(spark, sf_dir))


_KNN = """WITH q AS (SELECT vec_id AS query, embedding AS x FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query, vec_id AS neighbor, e.label, round(list_sum(list_transform(list_zip(x, embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 6) AS distance FROM q JOIN embeddings e ON e.vec_id <> query),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor) AS rank FROM d)"""


@query(_KNN + " SELECT query, neighbor, distance, CAST(rank AS INT) AS rank FROM n WHERE rank <= 5")
def nearest_neighbors(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return similarity.nearest(e.filter(F.col("vec_id") % 20 == 0), e, 5, "vec_id", "vec_id", "embedding")


@query(_KNN + """, c AS (SELECT query, label, count(*) AS k FROM n WHERE rank <= 5 GROUP BY 1, 2) SELECT query, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY k DESC, label) AS i FROM c) WHERE i = 1""")
def neighbor_labels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = similarity.nearest(e.filter(F.col("vec_id") % 20 == 0), e, 5, "vec_id", "vec_id", "embedding")
    return similarity.knn_labels(near, e.select(F.col("vec_id").alias("neighbor"), "label"))


@query(with_ctes(*_R, "curve", "fmax") + " SELECT user_id, round(f, 6) AS fmax, CAST(row_number() OVER (ORDER BY round(f, 6) DESC, user_id) AS INT) AS rank FROM fmax")
def ranked_raters(spark, sf_dir):
    return selection.ranked_raters(W.ratings(spark, sf_dir))


def _fmax(source: str, keys: str) -> str:
    """SQL of the largest F1 over thresholds."""
    return f"""(SELECT {keys}, round(max(round(2.0::DOUBLE * tp / (n_pred + n_pos), 9)), 6) AS fmax FROM (
  SELECT {keys}, sum(p) OVER w AS tp, sum(n) OVER w AS n_pred, sum(p) OVER (PARTITION BY {keys}) AS n_pos
  FROM (SELECT {keys}, prediction AS threshold, count(*) AS n, sum(label) AS p FROM {source} GROUP BY ALL)
  WINDOW w AS (PARTITION BY {keys} ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {keys})"""


def _forward(steps: int) -> str:
    """SQL of forward selection, each step from the one before."""
    out, held = "", "(SELECT item_id, 0.0::DOUBLE AS s FROM ratings GROUP BY 1)"
    for k in range(1, steps + 1):
        taken = " AND ".join(["true", *(f"user_id <> (SELECT user_id FROM g{j})" for j in range(1, k))])
        out += f""", t{k} AS (SELECT user_id, item_id, label, round((s + prediction) / {k}, 9) AS prediction FROM ratings JOIN {held} h USING (item_id) WHERE {taken}),
g{k} AS (SELECT user_id, fmax FROM {_fmax(f't{k}', 'user_id')} ORDER BY fmax DESC, user_id LIMIT 1)"""
        members = " OR ".join(f"user_id = (SELECT user_id FROM g{j})" for j in range(1, k + 1))
        held = f"(SELECT item_id, sum(CASE WHEN {members} THEN prediction ELSE 0 END) AS s FROM ratings GROUP BY 1)"
    return out + " " + " UNION ALL ".join(f"SELECT {k}::INT AS step, user_id, fmax FROM g{k}" for k in range(1, steps + 1))


@query(
    with_ctes(*_R)
    + f""", a AS (SELECT user_id, label, rank() OVER (PARTITION BY user_id ORDER BY prediction) + (count(*) OVER (PARTITION BY user_id, prediction) - 1) / 2.0::DOUBLE AS r FROM ratings),
b AS (SELECT user_id, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label))) AS auc FROM a GROUP BY user_id),
k AS (SELECT user_id, row_number() OVER (ORDER BY round(auc, 6) DESC, user_id) AS rank FROM b),
m AS (SELECT s.range::INT AS size, item_id, max(label) AS label, round(avg(prediction), 9) AS prediction FROM ratings JOIN k USING (user_id) JOIN range(1, 9) s ON rank <= s.range GROUP BY ALL),
c AS (SELECT size, label, rank() OVER (PARTITION BY size ORDER BY prediction) + (count(*) OVER (PARTITION BY size, prediction) - 1) / 2.0::DOUBLE AS r FROM m),
d AS (SELECT size, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM c GROUP BY size)
SELECT size, auc, fmax FROM d JOIN {_fmax("m", "size")} USING (size)"""
)
def greedy_prefixes(spark, sf_dir):
    return selection.greedy_prefixes(W.ratings(spark, sf_dir))


@query(with_ctes(*_R) + _forward(4))
def greedy_forward(spark, sf_dir):
    return selection.greedy_forward(W.ratings(spark, sf_dir))


@query(with_ctes(*_R) + f" SELECT fold, min_by(user_id, (-fmax, user_id)) AS user_id, max(fmax) AS fmax FROM {_fmax('ratings', 'fold, user_id')} GROUP BY fold")
def best_rater_per_fold(spark, sf_dir):
    return selection.best_rater_per_fold(W.ratings(spark, sf_dir))


_FOLD_TABLE = """, t AS (SELECT user_id AS method, 'brier_loss' AS metric, fold, avg((label - prediction) ** 2) AS value FROM ratings GROUP BY user_id, fold UNION ALL SELECT user_id, 'mean_score', fold, avg(prediction) FROM ratings GROUP BY user_id, fold)"""


def _fold_table(spark, sf_dir):
    wide = W.ratings(spark, sf_dir).groupBy(F.col("user_id").alias("method"), "fold").agg(F.avg(F.pow(F.col("label") - F.col("prediction"), F.lit(2))).alias("brier_loss"), F.avg("prediction").alias("mean_score"))
    return selection.long_metrics(wide, ["method", "fold"], ["brier_loss", "mean_score"])


@query(with_ctes(*_R) + _FOLD_TABLE + " SELECT method, metric, round(avg(value), 6) AS mean, round(stddev(value), 6) AS spread, CAST(count(DISTINCT fold) AS BIGINT) AS folds FROM t GROUP BY 1, 2")
def consolidated_metrics(spark, sf_dir):
    return selection.consolidated(_fold_table(spark, sf_dir))


@query(with_ctes(*_R) + _FOLD_TABLE + " SELECT method, metric, fold, CAST(rank() OVER (PARTITION BY metric, fold ORDER BY CASE WHEN metric LIKE '%loss%' THEN round(value, 6) ELSE -round(value, 6) END) AS INT) AS rank FROM t")
def method_ranks(spark, sf_dir):
    return selection.rank_methods(_fold_table(spark, sf_dir).withColumn("value", F.round("value", 6)), ["metric", "fold"]).select("method", "metric", "fold", "rank")


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '([-0-9a-z_:.]+)') AS w FROM documents WHERE lang = 'en'), g AS (SELECT 1 AS n, unnest(w) AS ngram FROM t UNION ALL SELECT 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t),
c AS (SELECT n, ngram, count(*) AS count FROM g GROUP BY 1, 2) SELECT CAST(n AS INT) AS n, ngram, CAST(count AS BIGINT) AS count, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY count DESC, ngram) AS k FROM c) WHERE k <= 20""")
def frequent_ngrams(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("lang = 'en'").select(ngrams.tokenize(F.col("text")).alias("t"))
    return ngrams.most_frequent(ngrams.counts(docs, "t", [1, 2]), 20)


@query("""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '([-0-9a-z_:.]+)') AS w FROM benchmark), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: least(w[i], w[i + 1]) || ' ' || greatest(w[i], w[i + 1]))) AS ngram FROM t)
SELECT CAST(2 AS INT) AS n, ngram, CAST(count(*) AS BIGINT) AS count FROM g GROUP BY ngram""")
def unordered_bigrams(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(ngrams.tokenize(F.col("text")).alias("t"))
    return ngrams.counts(rows, "t", [2], ordered=False)


@query("""WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x::DOUBLE) AS c FROM e GROUP BY 1, 2), v AS (SELECT label, list(c ORDER BY pos) AS center FROM m GROUP BY label)
SELECT e.label, round(sum(list_sum(list_transform(list_zip(embedding, center), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) / (2 * count(*)), 6) AS dispersion, CAST(count(*) AS BIGINT) AS size FROM embeddings e JOIN v USING (label) GROUP BY e.label""")
def cluster_dispersion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return cluster.dispersion(e, cluster.centers(e, "label", "embedding"), "label", "embedding")


@query("""WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x::DOUBLE) AS c FROM e GROUP BY 1, 2), v AS (SELECT label AS nearest, list(c ORDER BY pos) AS center FROM m GROUP BY label),
d AS (SELECT vec_id, nearest, round(list_sum(list_transform(list_zip(embedding, center), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 6) AS distance FROM embeddings, v)
SELECT vec_id, nearest, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) AS k FROM d) WHERE k = 1""")
def nearest_centers(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return cluster.assign(e, F.broadcast(cluster.centers(e, "label", "embedding")), "vec_id", "embedding", "label")


@query("""WITH t AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY 1, 2), x AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS s FROM t),
h AS (SELECT -sum(n / s * ln(n / na)) AS hba, -sum(n / s * ln(n / nb)) AS hab, -sum(n / s * ln(na / s)) AS ha, -sum(n / s * ln(nb / s)) AS hb, sum(n * (n - 1) / 2) AS pairs, sum((na - 1) / 2 * n) AS ia, sum((nb - 1) / 2 * n) AS ib, max(s) * (max(s) - 1) / 2 AS total FROM x)
SELECT round(1 - hab / ha, 6) AS homogeneity, round(1 - hba / hb, 6) AS completeness, round(2 * (1 - hab / ha) * (1 - hba / hb) / ((1 - hab / ha) + (1 - hba / hb)), 6) AS v_measure,
  round((pairs - ia * ib / total) / ((ia + ib) / 2 - ia * ib / total), 6) + 0.0 AS adjusted_rand FROM h""")
def cluster_agreement(spark, sf_dir):
    return cluster.agreement(cluster.contingency(table(spark, sf_dir, "documents"), "lang", "source"))


@query("""WITH k AS (SELECT unnest(range(50)) AS k) SELECT round(k * 500.0::DOUBLE / 49, 6) AS x, round(avg(exp(-(((k * (500.0::DOUBLE / 49) - value) / 20.0::DOUBLE) ** 2) / 2) / (20.0::DOUBLE * 2.5066282746310002)), 6) AS density FROM events, k GROUP BY k""")
def value_density(spark, sf_dir):
    return cluster.kernel_density(table(spark, sf_dir, "events"), "value", 20.0, 0.0, 500.0)


@query("""WITH w AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(avg(value), 6) AS mean, round(stddev(value), 6) AS spread, round(median(value), 6) AS median, min(value) FILTER (k = floor(n * 0.05::DOUBLE)) AS low, min(value) FILTER (k = floor(n * 0.95::DOUBLE)) AS high FROM w GROUP BY event_type""")
def score_intervals(spark, sf_dir):
    return sampling.interval(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""WITH c AS (SELECT quality AS label, count(*) AS n, round(count(*) * 0.2::DOUBLE)::BIGINT AS t FROM labels GROUP BY 1),
s AS (SELECT label, 'test' AS split, t AS n FROM c UNION ALL SELECT label, 'train', n - t FROM c) SELECT * FROM s WHERE n > 0""")
def stratified_counts(spark, sf_dir):
    items = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("label"))
    return sampling.stratified_split(items).groupBy("label", "split").agg(F.count("*").alias("n"))


@query()
def bootstrap_interval(spark, sf_dir):
    means = sampling.bootstrap_means(table(spark, sf_dir, "labels"), "quality", "doc_id")
    return means.agg(F.avg("mean").alias("mean"), F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


@query()
def als_reestimation(spark, sf_dir):
    """Weighted ALS of the confidence-weighted cells, unreliable cells re-estimated: errors before and after."""
    cells = stored(confidence.cell_confidence(W.colored(spark, sf_dir)).withColumn("weight", F.when(F.col("color") > 0, F.col("c0")).otherwise(0.0)))
    users, items = factors.als(factors.targets(cells, "rating").select("user_id", "item_id", "target", "weight"))
    renewed = factors.reestimate(factors.predict(users, items, cells))
    y = F.col("label")
    return renewed.groupBy("user_id").agg(F.avg(F.pow(y - F.col("prediction"), F.lit(2))).alias("brier_before"), F.avg(F.pow(y - F.col("renewed"), F.lit(2))).alias("brier_after"))


@query()
def stacked_performance(spark, sf_dir):
    """A logistic regression stacked on the raters' scores: fitted on folds 1 to 4, judged on fold 0."""
    r = W.ratings(spark, sf_dir)
    train, test = (reshape.to_wide(r.filter(c), W.USERS) for c in ("fold <> 0", "fold = 0"))
    scored = factors.stack(train, test, W.USERS).select(F.col("stacked").alias("prediction"), "label")
    return metrics.auc(scored.withColumn("m", F.lit("stack")), ["m"]).join(metrics.fmax(scored.withColumn("m", F.lit("stack")), ["m"]).select("m", "fmax"), "m")


@query()
def recommended_parts(spark, sf_dir):
    """Implicit ALS of ordered quantities: five parts for each customer."""
    model = factors.implicit(W.purchases(spark, sf_dir).select(F.col("user").cast("int"), F.col("item").cast("int"), "n"))
    users, items = (side.select("id", F.col("features").alias("vector")) for side in (model.userFactors, model.itemFactors))
    return topk.best_pairs(users, items, 5).select(F.col("query").alias("user"), F.col("neighbor").alias("item"), F.col("value").alias("score"))


@query("""SELECT o_custkey AS user, l_partkey AS item, round(CAST(sum(l_quantity) AS DOUBLE), 6) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def purchases(spark, sf_dir):
    return W.purchases(spark, sf_dir)


@query()
def kmeans_clusters(spark, sf_dir):
    _, points = cluster.kmeans(table(spark, sf_dir, "embeddings"), "embedding", 10)
    return cluster.agreement(cluster.contingency(points, "label", "prediction"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS user_id, CAST(count(*) AS BIGINT) AS n, round(avg(value / 500), 10) AS mean, round(avg(CAST((value / 500 >= 0.5) = (user_id % 2 = 1) AS INT)), 10) AS "right" FROM events GROUP BY 1, 2""", digits=10)
def windowed_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("user_id"), (F.col("value") / 500).alias("prediction"), (F.col("user_id") % 2).cast("int").alias("label"))
    return scores.windowed_scores(e, "1 day")


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS squared, CAST(len(embedding) - 8 + 1 AS INT) AS windows FROM embeddings""")
def vector_functions(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.dot(v, v), 5).alias("squared"), F.size(arrays.windows(v, 8)).alias("windows"))


@query("""SELECT user_id, round(ema, 6) AS ema FROM (SELECT user_id, last_value(e) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ema, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
  SELECT user_id, ts, event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) AS e FROM events)) WHERE k = 1""")
def moving_averages(spark, sf_dir):
    """The last mean of five values of each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("e", F.avg("value").over(w.rowsBetween(-4, 0)))
    return e.groupBy("user_id").agg(F.max_by("e", F.struct("ts", "event_id")).alias("ema"))


@query("""SELECT DISTINCT event_type AS name, upper(split_part(event_type, '_', 1)) AS head FROM events""")
def name_parts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.upper(F.get(F.split("event_type", "_"), F.lit(0))).alias("head")).distinct()


@query(with_ctes(*_R) + """ SELECT user_id, item_id, CASE WHEN prediction > 1 THEN 1 - 1e-9 WHEN prediction < 0 THEN 1e-9 ELSE prediction END AS clipped, round(exp(-((1 - prediction) ** 2) / 0.5::DOUBLE), 6) AS affinity, split_part(user_id, '.', 1) AS family, CAST(split_part(user_id, '.', 2) AS INT) AS bag FROM ratings""")
def scalar_functions(spark, sf_dir):
    p, u = F.col("prediction"), F.col("user_id")
    return W.ratings(spark, sf_dir).select("user_id", "item_id", scalar.clip_probability(p).alias("clipped"), scalar.affinity(p).alias("affinity"), scalar.family(u).alias("family"), scalar.bag(u).alias("bag"))


# These modules register their queries here when they are imported.
from raterlake.plans import draws, ensembles, estimation, factorization, filters, growth, neighbors, polarity, reports, structure  # noqa: E402, F401
