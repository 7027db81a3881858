"""Cells from the items of the same cluster, without a pair of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predict_items_by_cluster(ratings: DataFrame, clusters: DataFrame, parts: int = 16) -> DataFrame:
    """user_id, item_id, predicted: the mean of the rater's scores of all items of the cluster (the item included), weighted by the items' cosine.

    A cosine is a sum over raters, so the weighted sums of a cluster are products of the item's unit vector with sums over the cluster: a raters x raters table
    of unit scores times scores, and a row of unit scores. Work grows with the items and not with their pairs, and a hot cluster is summed before it is shuffled. Scores must be 0 or
    more, as those of probabilities are, so that no cosine is negative; a missing score counts as 0. Items without a score over 0 get null.
    """
    r = ratings.select("item_id", "user_id", F.col("prediction").alias("x")).filter("x is not null")
    norms = r.groupBy("item_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_norm"))
    unit = r.join(norms, "item_id").join(clusters.select("item_id", "cluster"), "item_id").withColumn("w", F.coalesce(F.try_divide("x", "_norm"), F.lit(0.0)))
    other = r.select("item_id", F.col("user_id").alias("b"), F.col("x").alias("y"))
    sums = unit.join(other, "item_id").groupBy("cluster", "user_id", "b").agg(F.sum(F.col("w") * F.col("y")).alias("m"))
    whole = unit.groupBy("cluster", "user_id").agg(F.sum("w").alias("v"))
    # A cluster's sums meet all of its items, so its items are dealt over several tasks, each of which gets the sums.
    salted = lambda df: df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    unit = unit.select("item_id", "cluster", "user_id", "w", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int").alias("_salt"))
    keys = ["cluster", "user_id", "_salt"]
    total = unit.join(salted(whole), keys).groupBy("item_id").agg(F.sum(F.col("w") * F.col("v")).alias("_total"))
    mixed = unit.join(salted(sums), keys).groupBy("item_id", F.col("b").alias("user_id")).agg(F.sum(F.col("w") * F.col("m")).alias("_mixed"))
    out = ratings.select("user_id", "item_id").distinct().join(mixed, ["user_id", "item_id"], "left").join(total, "item_id", "left")
    return out.select("user_id", "item_id", F.try_divide(F.coalesce("_mixed", F.lit(0.0)), F.when(F.col("_total") > 0, F.col("_total"))).alias("predicted"))
