"""Queries of draws and balanced cells, and of cells from clusters of items."""

from __future__ import annotations

from pyspark.sql import functions as F

from raterlake.operators import draws, item_clusters
from raterlake.plans import workload as W
from raterlake.plans.queries import _R, _V, query
from raterlake.plans.workload import with_ctes


@query(
    with_ctes(*_V)
    + """, c AS (SELECT user_id, count(*) FILTER (label = 1) AS ones, count(*) FILTER (label = 0) AS zeros FROM voted WHERE vote = label GROUP BY user_id)
SELECT user_id, ones, least(zeros, ones * 2) AS zeros, TRUE AS all_right FROM c WHERE ones > 0"""
)
def balanced_cells(spark, sf_dir):
    """How many right votes of each class are kept: twice as many of label 0 as of label 1."""
    kept = draws.balanced_cells(W.voted(spark, sf_dir), multiple=2)
    n = lambda k: F.count_if(F.col("label") == k)
    return kept.groupBy("user_id").agg(n(1).alias("ones"), n(0).alias("zeros"), F.bool_and(F.col("vote") == F.col("label")).alias("all_right"))


@query(
    with_ctes(*_R)
    + """, c AS (SELECT user_id, count(*) FILTER (label = 1) AS ones, count(*) FILTER (label = 0) AS zeros FROM ratings GROUP BY user_id)
SELECT user_id, ones, CAST(CASE WHEN zeros > 0 THEN ones * 2 ELSE 0 END AS BIGINT) AS draws FROM c WHERE ones > 0"""
)
def balanced_labels(spark, sf_dir):
    """Draws of label 0, for each rater: twice the items of label 1, some more than once where there are too few."""
    kept = draws.balanced_by_labels(W.ratings(spark, sf_dir), multiple=2)
    return kept.groupBy("user_id").agg(F.count_if(F.col("label") == 1).alias("ones"), F.sum(F.when(F.col("label") == 0, F.col("times")).otherwise(0)).alias("draws"))


@query(
    with_ctes(*_R)
    + """, r AS (SELECT *, row_number() OVER (ORDER BY prediction, user_id, item_id) AS k, count(*) OVER () AS n FROM ratings)
SELECT ((k * 20 - 1) // n)::INT AS part, count(*) AS n, min(prediction) AS low, max(prediction) AS high, TRUE AS inside FROM r GROUP BY 1"""
)
def interval_samples(spark, sf_dir):
    """Twenty intervals of all scores, and whether the score drawn from each lies in it."""
    r, order = W.ratings(spark, sf_dir), ["prediction", "user_id", "item_id"]
    cut = draws.in_intervals(r, order, 20).groupBy("part").agg(F.count("*").alias("n"), F.min("prediction").alias("low"), F.max("prediction").alias("high"))
    drawn = draws.interval_sample(r, order, 20, ["user_id", "item_id"]).select("part", F.col("prediction").alias("_x"))
    return cut.join(drawn, "part").select("part", "n", "low", "high", F.col("_x").between(F.col("low"), F.col("high")).alias("inside"))


@query()
def density_draws(spark, sf_dir):
    """Scores drawn from the density of those of positives; the rows drawn are tested against a plain search."""
    r = W.ratings(spark, sf_dir).filter("label = 1").withColumn("cell", F.concat_ws("/", "user_id", "item_id"))
    return draws.density_draws(r, "cell", "prediction", 0.05, 1000).select("draw", "user_id", "item_id", "prediction")


@query(
    with_ctes(*_R)
    + """, norms AS (SELECT item_id, sqrt(sum(prediction ** 2)) AS norm FROM ratings GROUP BY item_id),
u AS (SELECT item_id, user_id, prediction AS x, coalesce(prediction / nullif(norm, 0), 0) AS w, item_id % 25 AS cluster FROM ratings JOIN norms USING (item_id)),
s AS (SELECT a.item_id AS i, b.item_id AS j, sum(a.w * b.w) AS s FROM u a JOIN u b ON a.cluster = b.cluster AND a.user_id = b.user_id GROUP BY ALL)
SELECT user_id, i AS item_id, round(sum(s * x) / nullif(sum(abs(s)), 0), 6) AS predicted FROM s JOIN u ON j = u.item_id GROUP BY ALL"""
)
def item_cluster_prediction(spark, sf_dir):
    """Cells from the items with the same remainder."""
    r = W.ratings(spark, sf_dir)
    return item_clusters.predict_items_by_cluster(r, r.select("item_id").distinct().withColumn("cluster", F.col("item_id") % 25))
