"""Stacking inside clusters of raters, and across them.

All clusters' models come from one pass: sums of products of two raters of one cluster, and of each with the label, are grouped by cluster, and each cluster's ridge regression is
solved from its few sums where they lie. Items meet their cluster's weights in a join, so nothing is fitted or predicted a cluster at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlake.operators import ensembles, similarity

#: The constant beside the raters of a model.
CONSTANT = ""


def rater_clusters(ratings: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """user_id, cluster: k-means of raters by their rows of distances sqrt(1 - |correlation|) to all raters (a row has one number a rater)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    apart = similarity.pearson(ratings).select("a", "b", F.sqrt(1 - F.abs(F.coalesce("correlation", F.lit(0.0)))).alias("d"))
    rows = apart.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]).alias("row"))
    points = rows.select(F.col("a").alias("user_id"), array_to_vector("row").alias("features"))
    return KMeans(k=k, seed=seed).fit(points).transform(points).select("user_id", F.col("prediction").alias("cluster"))


def ridge_weights(ratings: DataFrame, keys: list[str], penalty: float = 1.0) -> DataFrame:
    """keys, user_id, weight: for each value of keys the least squares of the labels on its raters' scores and a constant (user_id ""), with ``penalty`` times the squared
    weights of all but the constant. A missing cell counts as 0."""
    constant = ratings.groupBy(*keys, "item_id").agg(F.max("label").alias("label")).select(*keys, F.lit(CONSTANT).alias("user_id"), "item_id", F.lit(1.0).alias("prediction"), "label")
    sums = ensembles.products(ratings.select(*keys, "user_id", "item_id", "prediction", "label").unionByName(constant), keys)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        users = sorted(set(rows.a))
        at = {u: k for k, u in enumerate(users)}
        a, b = np.zeros((len(users), len(users))), np.zeros(len(users))
        for x, y, xy in zip(rows.a, rows.b, rows.xy, strict=True):
            if y is None or y != y:
                b[at[x]] = xy
            else:
                a[at[x], at[y]] = a[at[y], at[x]] = xy
        w = np.linalg.solve(a + penalty * np.diag([0.0 if u == CONSTANT else 1.0 for u in users]), b)
        return pd.DataFrame({**{k: rows[k].iloc[0] for k in keys}, "user_id": users, "weight": w})

    # A product of a rater with itself isn't among pairs of different ones.
    squares = ratings.groupBy(*keys, "user_id").agg(F.sum(F.col("prediction") * F.col("prediction")).alias("xy")).select(*keys, F.col("user_id").alias("a"), F.col("user_id").alias("b"), "xy")
    ones = constant.groupBy(*keys).agg(F.sum("prediction").alias("xy")).select(*keys, F.lit(CONSTANT).alias("a"), F.lit(CONSTANT).alias("b"), "xy")
    whole = sums.filter("b IS NULL OR a <> b").unionByName(squares).unionByName(ones)
    types = ", ".join(f"{k} {ratings.schema[k].dataType.simpleString()}" for k in keys)
    return whole.groupBy(*keys).applyInPandas(solve, f"{types}, user_id string, weight double")


def _combined(ratings: DataFrame, weights: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, item_id and the weighted sum of each item's cells plus the constant."""
    constant = weights.filter(F.col("user_id") == CONSTANT).select(*keys, F.col("weight").alias("_c"))
    sums = ratings.join(weights, [*keys, "user_id"]).groupBy(*keys, "item_id").agg(F.sum(F.col("weight") * F.col("prediction")).alias("_s"))
    return sums.join(constant, keys).select(*keys, "item_id", (F.col("_s") + F.col("_c")).alias(name))


def stacked_inside(train: DataFrame, test: DataFrame, clusters: DataFrame, penalty: float = 1.0) -> DataFrame:
    """item_id, cluster, inside, stacked of test items: each cluster's model of its own raters, and the mean of all clusters' models. clusters: user_id, cluster."""
    fitted = ridge_weights(train.join(clusters, "user_id"), ["cluster"], penalty)
    inside = _combined(test.join(clusters, "user_id"), fitted, ["cluster"], "inside")
    return inside.withColumn("stacked", F.avg("inside").over(Window.partitionBy("item_id")))


def stacked_across(train: DataFrame, test: DataFrame, clusters: DataFrame, penalty: float = 1.0) -> DataFrame:
    """item_id, stacked of test items: one model of the clusters' mean scores."""

    def means(ratings: DataFrame, *more: str) -> DataFrame:
        out = ratings.join(clusters, "user_id").groupBy(F.col("cluster").cast("string").alias("user_id"), "item_id", *more).agg(F.avg("prediction").alias("prediction"))
        return out.withColumn("all", F.lit(0))

    fitted = ridge_weights(means(train, "label"), ["all"], penalty)
    return _combined(means(test), fitted, ["all"], "stacked").drop("all")
