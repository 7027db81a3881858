"""Combining the scores of many raters, and summaries of distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.functions import scalar


def unbag(ratings: DataFrame) -> DataFrame:
    """Scores of a rater's bags averaged: one row for each family and item."""
    return ratings.groupBy(scalar.family(F.col("user_id")).alias("user_id"), "item_id").agg(F.avg("prediction").alias("prediction"), F.max("label").alias("label"))


def bag_counts(ratings: DataFrame) -> DataFrame:
    return ratings.select(scalar.family(F.col("user_id")).alias("family"), scalar.bag(F.col("user_id")).alias("bag")).distinct().groupBy("family").agg(F.count("*").alias("bags"))


def first_bags(ratings: DataFrame, n: int) -> DataFrame:
    """Only the first n bags of each rater."""
    names = ratings.select("user_id").distinct()
    rank = F.row_number().over(Window.partitionBy(scalar.family(F.col("user_id"))).orderBy(scalar.bag(F.col("user_id")), "user_id"))
    return ratings.join(F.broadcast(names.withColumn("_k", rank).filter(F.col("_k") <= n).select("user_id")), "user_id", "left_semi")


def combine(ratings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean, median, sum, lowest and highest score of each item."""
    p = F.col("prediction")
    return ratings.groupBy(*(keys or ["item_id"])).agg(
        F.avg(p).alias("mean"), F.median(p).alias("median"), F.sum(p).alias("total"), F.min(p).alias("low"), F.max(p).alias("high"), F.max("label").alias("label")
    )


def combine_reliable(ratings: DataFrame, keep: str = "reliable") -> DataFrame:
    """Mean of the kept cells of each item; of all where none is kept."""
    kept = F.avg(F.when(F.col(keep) != 0, F.col("prediction")))
    return ratings.groupBy("item_id").agg(F.coalesce(kept, F.avg("prediction")).alias("mean"), F.sum(F.col(keep)).alias("kept"), F.max("label").alias("label"))


def weighted(ratings: DataFrame, weight: str) -> DataFrame:
    """Weighted mean of each item; the plain mean where all weights are 0."""
    w, p = F.col(weight), F.col("prediction")
    return ratings.groupBy("item_id").agg(F.coalesce(F.try_divide(F.sum(w * p), F.sum(w)), F.avg(p)).alias("weighted"), F.max("label").alias("label"))


def softmax_weighted(ratings: DataFrame, weight: str) -> DataFrame:
    """Mean of each item weighted by the softmax of the weights."""
    top = F.max(weight).over(Window.partitionBy("item_id"))
    e = ratings.withColumn("_e", F.exp(F.col(weight) - top))
    return e.groupBy("item_id").agg((F.sum(F.col("_e") * F.col("prediction")) / F.sum("_e")).alias("softmax_mean"))


def fill_masked(ratings: DataFrame, keep: str = "reliable", by: str = "item_id") -> DataFrame:
    """Masked cells replaced by the mean of the kept ones of the item (or user); of all where none is kept."""
    w = Window.partitionBy(by)
    mean = F.coalesce(F.avg(F.when(F.col(keep) != 0, F.col("prediction"))).over(w), F.avg("prediction").over(w))
    return ratings.withColumn("filled", F.when(F.col(keep) != 0, F.col("prediction")).otherwise(mean))


def centered(ratings: DataFrame, by: str = "user_id") -> DataFrame:
    return ratings.withColumn("centered", F.col("prediction") - F.avg("prediction").over(Window.partitionBy(by)))


def scaled(ratings: DataFrame, by: list[str]) -> DataFrame:
    """Min-max scaled scores; 0 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min("prediction").over(w), F.max("prediction").over(w)
    return ratings.withColumn("scaled", F.coalesce(F.try_divide(F.col("prediction") - low, high - low), F.lit(0.0)))


def unit_length(ratings: DataFrame, by: str = "user_id") -> DataFrame:
    length = F.sqrt(F.sum(F.pow("prediction", F.lit(2))).over(Window.partitionBy(by)))
    return ratings.withColumn("normalized", F.when(length > 0, F.col("prediction") / length).otherwise(F.col("prediction")))


def five_numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles with linear interpolation."""
    q = F.percentile(value, F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    return df.groupBy(*keys).agg(q.alias("_q")).select(*keys, *(F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(("low", "q1", "median", "q3", "high"))))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value at half of the weight: the heaviest if it holds over half, the mean of two neighbours when half falls between."""
    each = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"))
    up, whole = Window.partitionBy(*keys).orderBy("_v"), Window.partitionBy(*keys)
    c = each.withColumn("_cum", F.sum("_w").over(up)).withColumn("_half", F.sum("_w").over(whole) / 2.0).withColumn("_next", F.lead("_v").over(up))
    at = c.filter(F.col("_cum") >= F.col("_half")).groupBy(*keys).agg(F.min_by(F.struct("_v", "_cum", "_half", "_next"), "_v").alias("m"))
    between = F.coalesce((F.col("m._v") + F.col("m._next")) / 2.0, F.col("m._v").cast("double"))
    return at.select(*keys, F.when(F.col("m._cum") == F.col("m._half"), between).otherwise(F.col("m._v").cast("double")).alias("weighted_median"))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value, the smallest among equals, with its count."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"), F.max("n").alias("mode_n"))


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shannon entropy in bits and Gini impurity of a value's distribution."""
    p = df.groupBy(*keys, value).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    return p.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), (1 - F.sum(F.col("p") * F.col("p"))).alias("gini"))


def information_gain(df: DataFrame, target: str, feature: str) -> DataFrame:
    """One row: the entropy of the target, its rest given the feature, and the gain."""
    levels = df.groupBy(feature).agg(F.count("*").alias("n"))
    inside = entropy(df, [feature], target).join(levels, feature).agg((F.sum(F.col("entropy") * F.col("n")) / F.sum("n")).alias("rest"))
    whole = entropy(df.withColumn("_all", F.lit(1)), ["_all"], target).select(F.col("entropy").alias("total"))
    return whole.crossJoin(inside).withColumn("gain", F.col("total") - F.col("rest"))


def missing_profile(df: DataFrame, value: Column, missing: float) -> DataFrame:
    return df.agg(F.count("*").alias("cells"), F.count_if(value == missing).alias("missing"), (F.count_if(value == missing) / F.count("*")).alias("missing_ratio"))


def mean_centered_observed(ratings: DataFrame) -> DataFrame:
    """Scores less their item's mean over the raters who gave one."""
    w = Window.partitionBy("item_id")
    return ratings.withColumn("normal", F.col("prediction") - F.sum("prediction").over(w) / (F.count("prediction").over(w) + 1e-12))


def scaled_by(rows: DataFrame, fitted_on: DataFrame, by: str = "user_id") -> DataFrame:
    """Scores scaled by the least and largest ones of other rows; 0 where those are equal."""
    bounds = fitted_on.groupBy(by).agg(F.min("prediction").alias("_lo"), F.max("prediction").alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col("prediction") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return rows.join(bounds, by).withColumn("scaled", scaled).drop("_lo", "_hi")


def places(counts: DataFrame, score: str, key: str) -> DataFrame:
    """Adds place (long): 1 for the largest score, smaller keys first; for short tables such as counts of codes."""
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), key)).cast("long"))
