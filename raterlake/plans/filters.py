"""Queries of filters, their alignment and thresholds, and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from raterlake.operators import alignment, confidence, labels, metrics, reports
from raterlake.plans import workload as W
from raterlake.plans.queries import _C, _R, query
from raterlake.plans.workload import with_ctes

_KEEP = ", k AS (SELECT c.*, CAST(vote = majority AS INT) AS agrees FROM colored c JOIN majority m USING (item_id))"
_KEPT = with_ctes(*_C, "majority") + _KEEP


@query(
    _KEPT
    + """, n AS (SELECT user_id, 1.0::DOUBLE * count(*) FILTER (agrees = 1 AND color > 0) AS kr, 1.0::DOUBLE * count(*) FILTER (agrees = 1 AND color <= 0) AS kw,
  1.0::DOUBLE * count(*) FILTER (agrees <> 1 AND color > 0) AS lr, 1.0::DOUBLE * count(*) FILTER (agrees <> 1 AND color <= 0) AS lw,
  1.0::DOUBLE * count(*) FILTER (label = 1 AND agrees = 1 AND color > 0) AS pk, 1.0::DOUBLE * count(*) FILTER (label = 1 AND (agrees = 1) <> (color > 0)) AS pw,
  1.0::DOUBLE * count(*) FILTER (label = 1 AND (agrees = 1) = (color > 0)) AS pa FROM k GROUP BY user_id)
SELECT user_id, round((kr + lw) / (kr + kw + lr + lw), 6) AS aligned, round(kr / nullif(kr + lr, 0), 6) AS aligned_pos, round(lw / nullif(kw + lw, 0), 6) AS aligned_neg,
  round(pa / nullif(kr + lw, 0), 6) AS positive, round(2 * kr / nullif(2 * kr + lr + kw, 0), 6) AS f_beta, round((kr + 1) / (kw + lr + 1), 6) AS hit_to_miss,
  round((pk + 1) / (pw + 1), 6) AS positive_hit_to_miss, round(kw / nullif(kr + kw, 0), 6) AS fp_fn FROM n"""
)
def alignment_scores(spark, sf_dir):
    kept = labels.agreeing_with_majority(W.voted(spark, sf_dir))
    return alignment.alignment(labels.colored(kept), F.col("agrees"), ["user_id"])


@query(
    with_ctes(*_C)
    + """, s AS (SELECT user_id, reliable, least(floor(round(abs(prediction - p_th), 6) / 0.01::DOUBLE + 1e-9), 99) AS level FROM colored),
t AS (SELECT user_id, i AS level FROM (SELECT DISTINCT user_id FROM s), range(5, 100) r(i)),
g AS (SELECT t.user_id, t.level, round(count(*) FILTER ((s.level >= t.level) = (reliable = 1)) / count(*)::DOUBLE, 9) AS aligned FROM t JOIN s USING (user_id) GROUP BY 1, 2)
SELECT user_id, round(level * 0.01::DOUBLE, 6) AS threshold, round(aligned, 6) AS aligned FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY aligned DESC, level) AS n FROM g) WHERE n = 1"""
)
def calibrated_filters(spark, sf_dir):
    cells = W.colored(spark, sf_dir).withColumn("sure", F.round(F.abs(F.col("prediction") - F.col("p_th")), 6))
    return alignment.calibrated(cells, ["user_id"], "sure")


_RTH = """, s AS (SELECT user_id, item_id, reliable, label, vote, round(abs(prediction - p_th), 6) AS sure FROM colored),
tot AS (SELECT user_id, sum(reliable) AS pos, count(*) - sum(reliable) AS neg FROM s GROUP BY 1),
d AS (SELECT user_id, sure, sum(count(*)) OVER w AS n, sum(sum(reliable)) OVER w AS tp FROM s GROUP BY user_id, sure WINDOW w AS (PARTITION BY user_id ORDER BY sure DESC ROWS UNBOUNDED PRECEDING)),
b AS (SELECT user_id, sure, round((tp / nullif(pos, 0)::DOUBLE + 1 - (n - tp) / nullif(neg, 0)::DOUBLE) / 2, 9) AS bal FROM d JOIN tot USING (user_id)),
r AS (SELECT user_id, sure AS r_th, bal FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bal DESC, sure) AS k FROM b WHERE bal IS NOT NULL) WHERE k = 1)"""


@query(with_ctes(*_C) + _RTH + " SELECT user_id, r_th, round(bal, 6) AS balanced_accuracy FROM r")
def reliability_thresholds(spark, sf_dir):
    return alignment.reliability_thresholds(W.colored(spark, sf_dir))


@query(
    with_ctes(*_C)
    + _RTH
    + """ SELECT user_id, CAST(sum(CAST(sure >= r_th AS INT)) AS BIGINT) AS trusted, CAST(sum(CAST(sure >= r_th AND reliable = 1 AS INT)) AS BIGINT) AS right_trusted,
  round(avg(CAST(vote = label AS INT)) FILTER (sure >= r_th), 6) AS accuracy FROM s JOIN r USING (user_id) GROUP BY user_id"""
)
def hardened_filters(spark, sf_dir):
    cells = W.colored(spark, sf_dir)
    trusted = alignment.hardened(cells, alignment.reliability_thresholds(cells))
    yes = F.col("trusted") == 1
    right = (F.col("vote") == F.col("label")).cast("int")
    return trusted.groupBy("user_id").agg(F.count_if(yes).alias("trusted"), F.count_if(yes & (F.col("reliable") == 1)).alias("right_trusted"), F.avg(F.when(yes, right)).alias("accuracy"))


_MASK = """, m AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(abs(prediction - p_th), 6) DESC, user_id) <= greatest(floor(count(*) OVER (PARTITION BY item_id) * 0.5), 1) AS INT) AS kept FROM colored)"""


def _masked(spark, sf_dir):
    sure = F.round(F.abs(F.col("prediction") - F.col("p_th")), 6)
    return alignment.mask_over(alignment.surest_users(W.colored(spark, sf_dir), sure), "kept", "prediction")


@query(with_ctes(*_C) + _MASK + " SELECT user_id, item_id, kept, CASE WHEN kept <> 0 THEN prediction ELSE 0.0::DOUBLE END AS masked, CASE WHEN kept <> 0 THEN 0.0::DOUBLE ELSE prediction END AS complement FROM m")
def dual_masks(spark, sf_dir):
    return _masked(spark, sf_dir).select("user_id", "item_id", "kept", "masked", "complement")


@query(
    with_ctes(*_C)
    + _MASK
    + """, v AS (SELECT user_id, CASE WHEN kept <> 0 THEN prediction ELSE 0.0::DOUBLE END AS x FROM m)
SELECT user_id, count(*) AS cells, count(*) FILTER (x = 0) AS masked, round(count(*) FILTER (x = 0) / count(*)::DOUBLE, 6) AS masked_ratio, bool_or(x > 0) AS effective FROM v GROUP BY user_id"""
)
def mask_profiles(spark, sf_dir):
    return alignment.mask_profile(_masked(spark, sf_dir), ["user_id"], "masked")


@query(
    with_ctes(*_C)
    + _MASK
    + """, t AS (SELECT user_id, label, prediction, row_number() OVER (PARTITION BY user_id, label ORDER BY CASE WHEN label = 1 THEN -prediction ELSE prediction END, item_id) AS k FROM m WHERE kept <> 0)
SELECT user_id, label, count(*) AS n, array_to_string(list(printf('%.6f', prediction) ORDER BY k) FILTER (k <= 5), ',') AS top FROM t GROUP BY user_id, label"""
)
def top_unmasked(spark, sf_dir):
    out = reports.top_unmasked(_masked(spark, sf_dir), "kept", 5)
    return out.withColumn("top", F.array_join(F.transform("top", lambda x: F.format_string("%.6f", x)), ","))


@query(
    with_ctes(*_C)
    + """, i AS (SELECT item_id, label, fold, coalesce(avg(prediction) FILTER (reliable = 1), avg(prediction)) AS mean FROM colored GROUP BY ALL),
p AS (SELECT round(mean, 9) AS s, label FROM i WHERE fold <> 0), z AS (SELECT sum(label) AS pos, count(*) - sum(label) AS neg FROM p),
d AS (SELECT s, sum(count(*)) OVER w AS n, sum(sum(label)) OVER w AS tp FROM p GROUP BY s WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
b AS (SELECT s, round((tp / pos::DOUBLE + 1 - (n - tp) / neg::DOUBLE) / 2, 9) AS bal FROM d, z), t AS (SELECT s FROM b ORDER BY bal DESC, s LIMIT 1),
q AS (SELECT label, CAST(round(mean, 9) >= s AS INT) AS vote FROM i, t WHERE fold = 0)
SELECT count(*) FILTER (label = 1 AND vote = 1) AS tp, count(*) FILTER (label = 0 AND vote = 0) AS tn, count(*) FILTER (label = 0 AND vote = 1) AS fp, count(*) FILTER (label = 1 AND vote = 0) AS fn FROM q"""
)
def labels_by_reliable_cells(spark, sf_dir):
    """The threshold of items combined from reliable cells, fitted on all folds but one and applied to that one."""
    cells = W.colored(spark, sf_dir)
    mean = F.coalesce(F.avg(F.when(F.col("reliable") == 1, F.col("prediction"))), F.avg("prediction"))
    items = cells.groupBy("item_id", "label", "fold").agg(F.round(mean, 9).alias("prediction"))
    best = metrics.balanced_threshold(items.filter("fold <> 0"), []).select("threshold")
    test = items.filter("fold = 0").crossJoin(F.broadcast(best)).withColumn("vote", (F.col("prediction") >= F.col("threshold")).cast("int"))
    return metrics.confusion(test, []).select("tp", "tn", "fp", "fn")


@query(with_ctes(*_R) + """, s AS (SELECT user_id, item_id, label, rank() OVER (PARTITION BY user_id ORDER BY prediction) / count(*) OVER (PARTITION BY user_id)::DOUBLE AS a,
  rank() OVER (PARTITION BY item_id ORDER BY prediction) / count(*) OVER (PARTITION BY item_id)::DOUBLE AS b FROM ratings WHERE label = 1) SELECT user_id, item_id, round(a * b, 6) AS product FROM s""")
def rank_products(spark, sf_dir):
    return reports.rank_products(W.ratings(spark, sf_dir))


@query(with_ctes(*_C) + " SELECT user_id, item_id, CASE WHEN polarity <> 0 THEN prediction ELSE 0.0::DOUBLE END AS cp FROM colored")
def neutral_masked(spark, sf_dir):
    return alignment.without_neutral(W.colored(spark, sf_dir), "prediction").select("user_id", "item_id", "cp")
