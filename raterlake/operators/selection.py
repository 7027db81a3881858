"""Ranking methods and choosing ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlake.functions import scalar
from raterlake.operators import combine, metrics
from raterlake.operators.state import stored


def ranked_raters(ratings: DataFrame, metric: str = "fmax") -> DataFrame:
    """user_id, the metric, rank: best first, names among equals."""
    scores = metrics.performance(ratings, ["user_id"]).select("user_id", F.round(metric, 6).alias(metric))
    order = F.desc(metric) if metric not in ("brier_loss", "log_loss", "rmse") else F.asc(metric)
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(order, "user_id")))


def rank_methods(table: DataFrame, within: list[str]) -> DataFrame:
    """Ranks of a long table (method, metric, value): losses ascending, all others descending, equal values alike."""
    key = F.when(scalar.higher_is_better(F.col("metric")), -F.col("value")).otherwise(F.col("value"))
    return table.withColumn("rank", F.rank().over(Window.partitionBy(*within).orderBy(key)))


def long_metrics(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return wide.select(*keys, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(keys, names, "metric", "value")


def consolidated(table: DataFrame) -> DataFrame:
    """Means over folds of a long metrics table, with their spread and number of folds."""
    return table.groupBy("method", "metric").agg(F.avg("value").alias("mean"), F.stddev("value").alias("spread"), F.count_distinct("fold").alias("folds"))


def one_standard_error(table: DataFrame, score: str, order: str) -> DataFrame:
    """The first row by order whose score is within one standard error of the best."""
    top = table.agg(F.max(score).alias("_top"), (F.stddev(score) / F.sqrt(F.count("*") - 1)).alias("_se"))
    return table.crossJoin(top).filter(F.col(score) >= F.col("_top") - F.col("_se")).drop("_top", "_se").orderBy(order).limit(1)


def greedy_prefixes(ratings: DataFrame, metric: str = "auc", most: int = 8) -> DataFrame:
    """The mean of the best k raters for k = 1, 2, ... as one query: size, auc, fmax. Ranking by single score, raters of rank r belong to all
    prefixes from r on."""
    rank = ranked_raters(ratings, metric).filter(F.col("rank") <= most)
    sizes = ratings.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("size"))
    members = F.broadcast(rank.select("user_id", "rank").join(sizes, F.col("rank") <= F.col("size")).select("user_id", "size"))
    means = ratings.join(members, "user_id").groupBy("size", "item_id").agg(F.round(F.avg("prediction"), 9).alias("prediction"), F.max("label").alias("label"))
    return metrics.auc(means, ["size"]).join(metrics.fmax(means, ["size"]).select("size", "fmax"), "size")


def greedy_forward(ratings: DataFrame, steps: int = 4) -> DataFrame:
    """Forward selection: each step adds the rater whose inclusion gives the best F-max of the mean. step, user_id, fmax.

    Each step is one aggregate over candidates x items; what comes to the driver is one rater's name. Ratings and sums are written out, so that no step makes them again.
    """
    chosen: list[tuple[int, str, float]] = []
    ratings = stored(ratings.select("user_id", "item_id", "prediction", "label"))
    sums = ratings.select("item_id", "label").distinct().withColumn("_s", F.lit(0.0))
    rest = ratings
    for step in range(1, steps + 1):
        tried = rest.join(sums.select("item_id", "_s"), "item_id").withColumn("prediction", F.round((F.col("_s") + F.col("prediction")) / step, 9))
        best = metrics.fmax(tried, ["user_id"]).withColumn("fmax", F.round("fmax", 6)).orderBy(F.desc("fmax"), "user_id").first()
        if best is None:
            break
        chosen.append((step, best["user_id"], best["fmax"]))
        taken = rest.filter(F.col("user_id") == best["user_id"]).select("item_id", F.col("prediction").alias("_p"))
        if step < steps:
            sums = stored(sums.join(taken, "item_id", "left").withColumn("_s", F.col("_s") + F.coalesce("_p", F.lit(0.0))).drop("_p"))
        rest = rest.filter(F.col("user_id") != best["user_id"])
    return ratings.sparkSession.createDataFrame(chosen, "step int, user_id string, fmax double")


def best_rater_per_fold(ratings: DataFrame) -> DataFrame:
    """fold, the rater with the best F-max, and it."""
    scores = metrics.fmax(ratings, ["fold", "user_id"]).withColumn("fmax", F.round("fmax", 6))
    return scores.groupBy("fold").agg(F.min_by("user_id", F.struct(-F.col("fmax"), F.col("user_id"))).alias("user_id"), F.max("fmax").alias("fmax"))


def fold_means(ratings: DataFrame) -> DataFrame:
    """The mean of all raters for each fold and item."""
    return combine.combine(ratings, ["fold", "item_id"]).select("fold", "item_id", "mean", "label")
