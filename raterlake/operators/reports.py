"""Tables over methods, folds and parameters: best ones, parts of a ranking, prior against posterior, profiles of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_kinds(df: DataFrame, keys: list[str], value: str, codes: list[int], most: int = 10) -> DataFrame:
    """keys, n_values, and whether the values are binary, few (2 to most), codes only, or a label prediction (two at most)."""
    n = F.count_distinct(value)
    out = df.groupBy(*keys).agg(n.alias("n_values"), F.bool_and(F.col(value).isin(codes)).alias("coded"))
    c = F.col("n_values")
    return out.select(*keys, "n_values", (c == 2).alias("is_binary"), c.between(2, most).alias("multivalued"), "coded", (c <= 2).alias("label_prediction"))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mean, variance (of the population), low and high."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.min(value).alias("low"), F.max(value).alias("high"))


def by_frequency(df: DataFrame, key: str, value: str, min_freq: int = 0) -> DataFrame:
    """key, n, mean, and its places by n and by mean (larger keys first among equals)."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 9).alias("mean")).filter(F.col("n") >= min_freq)
    place = lambda c: F.row_number().over(Window.orderBy(F.desc(c), F.desc(key)))
    # One row for each key of a report, so one sort.
    return sizes.withColumn("by_n", place("n")).withColumn("by_mean", place("mean"))


def parts_of_ranking(ranked: DataFrame, score: str, key: str, parts: int) -> DataFrame:
    """Adds part: 1 for the best methods to parts for the last; sizes differ by one at most."""
    return ranked.withColumn("part", F.ntile(parts).over(Window.orderBy(F.desc(score), key)))


def summarized(df: DataFrame, keyword: str, method: str, value: str) -> DataFrame:
    """keyword, best, least, mean and median of a metric over the methods whose name holds the keyword."""
    return df.filter(F.col(method).contains(keyword)).agg(F.max(value).alias("best"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.median(value).alias("median")).withColumn("keyword", F.lit(keyword))


def compared(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of two confusion tables side by side: keys, prior and posterior accuracy and F1, and what changed in tp and tn."""
    a = before.select(*keys, F.col("accuracy").alias("prior_accuracy"), F.col("f1").alias("prior_f1"), F.col("tp").alias("_tp"), F.col("tn").alias("_tn"))
    b = after.select(*keys, F.col("accuracy").alias("posterior_accuracy"), F.col("f1").alias("posterior_f1"), "tp", "tn")
    out = a.join(b, keys)
    return out.select(*keys, "prior_accuracy", "posterior_accuracy", "prior_f1", "posterior_f1", (F.col("tp") - F.col("_tp")).alias("more_tp"), (F.col("tn") - F.col("_tn")).alias("more_tn"))


def best_params(df: DataFrame, params: str, value: str, top: int = 1) -> DataFrame:
    """The parameters with the largest mean value (smaller ones among equals): params, mean, n, place."""
    means = df.groupBy(params).agg(F.round(F.avg(value), 9).alias("mean"), F.count("*").alias("n"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), params))).filter(F.col("place") <= top)


def report(baseline: DataFrame, target: DataFrame, key: str, score: str) -> DataFrame:
    """One row: the best baseline and target, whether the best target beats the best baseline (max), all of them (max_all), and whether all
    targets beat all baselines (all_all)."""
    side = lambda df, name: df.agg(F.max_by(key, F.struct(score, key)).alias(name), F.max(score).alias(f"{name}_score"), F.min(score).alias(f"{name}_least"))
    out = side(baseline, "baseline").crossJoin(side(target, "target"))
    beats = F.col("target_score") > F.col("baseline_score")
    return out.select("baseline", "baseline_score", "target", "target_score", beats.alias("max_beats"), beats.alias("max_beats_all"), (F.col("target_least") > F.col("baseline_score")).alias("all_beat_all"))


def top_unmasked(cells: DataFrame, keep: str, k: int) -> DataFrame:
    """user_id, label, n, top: of each rater and class the k kept scores that stand for it: the highest of positives, the lowest of negatives."""
    order = F.when(F.col("label") == 1, -F.col("prediction")).otherwise(F.col("prediction"))
    kept = cells.filter(F.col(keep) != 0).withColumn("_k", F.row_number().over(Window.partitionBy("user_id", "label").orderBy(order, "item_id")))
    tops = F.array_sort(F.collect_list(F.when(F.col("_k") <= k, F.struct("_k", "prediction"))))
    return kept.groupBy("user_id", "label").agg(F.count("*").alias("n"), F.transform(tops, lambda x: x["prediction"]).alias("top"))


def modes_in_order(df: DataFrame, keys: list[str], value: str, order: str, condition: Column) -> DataFrame:
    """keys, mode (the value first seen among equally frequent ones) with its first place, among rows that meet the condition."""
    counts = df.filter(condition).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_at"))
    best = counts.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("mode"), F.col("_at").alias("first_at"), F.col("_n").alias("mode_n")), F.struct(-F.col("_n"), F.col("_at"))).alias("x"))
    return best.select(*keys, "x.mode", "x.first_at", "x.mode_n")


def rarest(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n rarest values (smaller ones among equals) with their counts."""
    counts = df.groupBy(value).agg(F.count("*").alias("count"))
    return counts.orderBy("count", value).limit(n)


def rank_products(ratings: DataFrame) -> DataFrame:
    """user_id, item_id, product: of positive items, the rank within the rater times the rank within the item (equal scores share the lower
    rank), both as shares."""
    share = lambda key: F.rank().over(Window.partitionBy(key).orderBy("prediction")) / F.count("*").over(Window.partitionBy(key))
    return ratings.filter("label = 1").select("user_id", "item_id", (share("user_id") * share("item_id")).alias("product"))
