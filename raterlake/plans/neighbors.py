"""Queries of neighbours across two sets of items, and of stacking by clusters of raters. Items of fold 0 are new, the others known."""

from __future__ import annotations

from pyspark.sql import functions as F

from raterlake.operators import cluster_stacking, labels, metrics, topk
from raterlake.operators.state import stored
from raterlake.plans import workload as W
from raterlake.plans.queries import _R, _V, query
from raterlake.plans.workload import with_ctes


def _split(df):
    return df.filter("fold = 0"), df.filter("fold <> 0")


def _ratings(spark, sf_dir):
    """Ratings made once: each use of them reads all texts otherwise."""
    return stored(W.ratings(spark, sf_dir))


def _similar(ratings):
    return topk.cross_similarity(*_split(ratings), W.USERS, 3)


_NEAR = """, c AS (SELECT item_id, user_id, fold, prediction, avg(prediction) OVER (PARTITION BY item_id) AS m FROM ratings),
s AS (SELECT a.item_id, b.item_id AS neighbor, round(sum((a.prediction - a.m) * (b.prediction - b.m)), 6) + 1e-9::DOUBLE AS similarity FROM c a JOIN c b USING (user_id)
  WHERE a.fold = 0 AND b.fold <> 0 GROUP BY ALL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, neighbor)::INT AS rank FROM s) WHERE rank <= 3)"""


def _mean(x: str) -> str:
    """SQL of the weighted mean that falls back to the plain one."""
    return f"coalesce(CASE WHEN abs(sum(similarity)) > 1e-7 THEN sum(similarity * {x}) / sum(similarity) END, avg({x}))"


@query(with_ctes(*_R) + _NEAR + " SELECT item_id, neighbor, round(similarity, 6) AS similarity, rank FROM near")
def cross_similarity(spark, sf_dir):
    """The three known items most like each new one."""
    return _similar(_ratings(spark, sf_dir))


@query(with_ctes(*_R) + _NEAR + f", f AS (SELECT *, (neighbor % 7 + 1) / 8.0::DOUBLE AS f0, (neighbor % 5 + 1) / 6.0::DOUBLE AS f1 FROM near) SELECT item_id, round({_mean('f0')}, 6) AS f0, round({_mean('f1')}, 6) AS f1 FROM f GROUP BY item_id")
def transferred_factors(spark, sf_dir):
    """Factors of new items; those of known ones are given by a formula of their ids."""
    part = lambda m: (F.col("item_id") % m + 1) / (m + 1.0)
    ratings = _ratings(spark, sf_dir)
    known = _split(ratings)[1].select("item_id").distinct().select("item_id", F.array(part(7), part(5)).alias("f"))
    out = topk.transferred_factors(_similar(ratings), known, 2)
    return out.select("item_id", F.get("f", F.lit(0)).alias("f0"), F.get("f", F.lit(1)).alias("f1"))


@query(with_ctes(*_V) + _NEAR + f", k AS (SELECT user_id, item_id AS neighbor, abs(prediction - p_th) AS sure FROM voted WHERE fold <> 0) SELECT user_id, item_id, round({_mean('sure')}, 6) AS sure FROM near JOIN k USING (neighbor) GROUP BY user_id, item_id")
def transferred_confidence(spark, sf_dir):
    """How far each rater's scores of the similar known items lie from its threshold, carried over to new items."""
    ratings = _ratings(spark, sf_dir)
    known = _split(labels.votes(ratings, metrics.thresholds(ratings, ["user_id"])))[1].withColumn("sure", F.abs(F.col("prediction") - F.col("p_th")))
    return topk.transferred_cells(_similar(ratings), known, "sure")


@query(
    with_ctes(*_R)
    + _NEAR
    + """, d AS (SELECT k.user_id, n.item_id, coalesce(sum(similarity * (k.prediction - k.m)) / nullif(sum(abs(similarity)), 0), 0) AS d FROM near n JOIN c k ON k.item_id = n.neighbor GROUP BY ALL)
SELECT d.user_id, d.item_id, round(m.m + d, 6) AS predicted FROM d JOIN (SELECT item_id, avg(prediction) AS m FROM ratings GROUP BY 1) m USING (item_id)"""
)
def predicted_new_items(spark, sf_dir):
    ratings = _ratings(spark, sf_dir)
    return topk.predicted_new_items(*_split(ratings), _similar(ratings))


def _families(spark):
    """A cluster for each kind of rater."""
    return spark.createDataFrame([(u, u.split(".")[0]) for u in W.USERS], "user_id string, cluster string")


@query(
    with_ctes(*_R)
    + """, x AS (SELECT item_id, fold, split_part(user_id, '.', 1) AS cluster, max(label) AS y, coalesce(max(prediction) FILTER (split_part(user_id, '.', 2) = '0'), 0) AS a,
  coalesce(max(prediction) FILTER (split_part(user_id, '.', 2) = '1'), 0) AS b FROM ratings GROUP BY ALL),
m AS (SELECT cluster, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + 1 AS aa, var_pop(b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab,
  covar_pop(a, y) * count(*) AS ya, covar_pop(b, y) * count(*) AS yb FROM x WHERE fold <> 0 GROUP BY cluster),
w AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS wb FROM m),
i AS (SELECT item_id, cluster, my + wa * (a - ma) + wb * (b - mb) AS inside FROM x JOIN w USING (cluster) WHERE fold = 0)
SELECT item_id, cluster, round(inside, 6) AS inside, round(avg(inside) OVER (PARTITION BY item_id), 6) AS stacked FROM i"""
)
def stacked_inside_clusters(spark, sf_dir):
    """Models of each kind of rater, and their mean."""
    new, known = _split(W.ratings(spark, sf_dir))
    return cluster_stacking.stacked_inside(known, new, _families(spark))


@query(
    with_ctes(*_R)
    + """, pairs AS (SELECT item_id, fold, label, CASE WHEN user_id < 'sp' THEN 'a' ELSE 'b' END AS cluster, avg(prediction) AS p FROM ratings GROUP BY ALL),
x AS (SELECT item_id, fold, max(label) AS y, max(p) FILTER (cluster = 'a') AS a, max(p) FILTER (cluster = 'b') AS b FROM pairs GROUP BY ALL),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + 1 AS aa, var_pop(b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab,
  covar_pop(a, y) * count(*) AS ya, covar_pop(b, y) * count(*) AS yb FROM x WHERE fold <> 0)
SELECT item_id, round(my + (ya * bb - yb * ab) / (aa * bb - ab * ab) * (a - ma) + (yb * aa - ya * ab) / (aa * bb - ab * ab) * (b - mb), 6) AS stacked FROM x, m WHERE fold = 0"""
)
def stacked_across_clusters(spark, sf_dir):
    """One model of two clusters' means: raters by length, and all others."""
    new, known = _split(W.ratings(spark, sf_dir))
    clusters = spark.createDataFrame([(u, 0 if u < "sp" else 1) for u in W.USERS], "user_id string, cluster int")
    return cluster_stacking.stacked_across(known, new, clusters)


@query()
def stacked_by_distance(spark, sf_dir):
    """The same by clusters of raters' correlations."""
    new, known = _split(W.ratings(spark, sf_dir))
    return cluster_stacking.stacked_inside(known, new, cluster_stacking.rater_clusters(known, 3))
