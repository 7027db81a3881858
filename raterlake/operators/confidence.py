"""Confidence weights of cells, users and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlake.operators import metrics


def user_confidence(colors: DataFrame) -> DataFrame:
    """user_id with 1 - Brier, accuracy, and correlation with the labels (null for constant scores)."""
    y, p = F.col("label"), F.col("prediction")
    spread = F.stddev_pop(p) * F.stddev_pop(y)
    return colors.groupBy("user_id").agg(
        (1 - F.avg(F.pow(y - p, 2))).alias("w_brier"),
        F.avg("reliable").alias("w_ratio"),
        F.try_divide(F.avg(y * p) - F.avg(y) * F.avg(p), spread).alias("w_corr"),
    )


def item_confidence(colors: DataFrame, suppress_majority: bool = False) -> DataFrame:
    """item_id with the share of users that are right, discounted for the majority class if asked."""
    out = colors.groupBy("item_id").agg(F.avg("reliable").alias("w_item"), F.max("label").alias("label"))
    if suppress_majority:
        whole = Window.partitionBy()
        n_pos, n = F.sum("label").over(whole), F.count("*").over(whole)
        ratio = F.try_divide(F.least(n_pos, n - n_pos), F.greatest(n_pos, n - n_pos))
        minority = F.when(n_pos * 2 <= n, 1).otherwise(0)
        out = out.withColumn("w_item", F.when(F.col("label") == minority, F.col("w_item")).otherwise(F.col("w_item") * ratio))
    return out


def cell_confidence(colors: DataFrame) -> DataFrame:
    """c0: the product of the user's and the item's confidence, for each cell."""
    out = colors.join(F.broadcast(user_confidence(colors).select("user_id", "w_brier")), "user_id")
    return out.join(item_confidence(colors).select("item_id", "w_item"), "item_id").withColumn("c0", F.col("w_brier") * F.col("w_item"))


def balanced(cells: DataFrame, alpha: float = 10.0) -> DataFrame:
    """cw: c0 weighted against the frequency of the cell's colour; cn: the same with wrong cells masked."""
    counts = cells.groupBy("color").agg(F.count("*").alias("_n"))
    inverse = 1.0 / F.col("_n")
    weights = counts.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy()))
    out = cells.join(F.broadcast(weights.select("color", "weight")), "color").withColumn("cw", alpha * F.col("weight") * F.col("c0"))
    return out.withColumn("cn", F.when(F.col("color") > 0, F.col("cw")).otherwise(0.0))


def average_ranks(ratings: DataFrame, by: str = "user_id") -> DataFrame:
    """The rank of each score among those of its rater (or item), equal ones sharing the mean rank; null scores have none. From running counts of distinct scores, so
    no rater's scores are sorted in one task."""
    counts = metrics.curve(ratings.select(by, "prediction", F.lit(0).alias("label")), [by])
    rank = F.col("n_neg") - F.col("n_pred") + (F.col("n") + 1) / 2.0
    return ratings.join(counts.select(by, F.col("threshold").alias("prediction"), rank.alias("average_rank")), [by, "prediction"], "left")


def outlier_bounds(voted: DataFrame) -> DataFrame:
    """Bounds by quartiles for each user and vote: q1 - 1.5 iqr and q3 + 1.5 iqr."""
    q = voted.groupBy("user_id", "vote").agg(F.percentile("prediction", F.lit(0.25)).alias("q1"), F.percentile("prediction", F.lit(0.75)).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.withColumn("lower", F.col("q1") - 1.5 * iqr).withColumn("upper", F.col("q3") + 1.5 * iqr)


def item_sequences(ratings: DataFrame, *columns: str) -> DataFrame:
    """For each item its cells in the order of users, as one array for each column."""
    cells = F.array_sort(F.collect_list(F.struct("user_id", *columns)))
    out = ratings.groupBy("item_id").agg(cells.alias("_c"))
    return out.select("item_id", *(F.col(f"_c.{c}").alias(f"{c}s") for c in ("user_id", *columns)))
