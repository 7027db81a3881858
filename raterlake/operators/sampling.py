"""Splits, samples and confidence intervals. Draws hash the key with a seed, so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.operators import metrics
from raterlake.operators.numbering import numbered, ranked


def draw(seed: int, *keys: str) -> Column:
    """A number in [0, 1) for each key."""
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def stratified_split(items: DataFrame, ratio: float = 0.2, seed: int = 7, key: str = "item_id", label: str = "label") -> DataFrame:
    """Adds split: test for the given share of each class, exactly to rounding."""
    rows = numbered(items.withColumn("_seed", F.lit(seed)), [label], ["_seed", key], "_k", "_of")
    return rows.withColumn("split", F.when(F.col("_k") < F.round(F.col("_of") * ratio), "test").otherwise("train")).select(*items.columns, "split")


def folds(items: DataFrame, n: int, key: str = "item_id") -> DataFrame:
    return items.withColumn("fold", F.pmod(F.col(key), F.lit(n)).cast("int"))


def near_equal_split(df: DataFrame, parts: int, order: str) -> DataFrame:
    """Adds part, 1 to parts: runs of the order whose sizes differ by one at most, the longer ones first."""
    n = df.count()
    size, longer = divmod(n, parts)
    k = F.col("_rank") - 1
    cut = longer * (size + 1)
    part = F.when(k < cut, F.floor(k / (size + 1))).otherwise(longer + F.floor((k - cut) / max(size, 1))) + 1
    return ranked(df, [F.asc(order)], "_rank").withColumn("part", part.cast("int")).select(*df.columns, "part")


def bootstrap_means(df: DataFrame, value: str, key: str, repetitions: int = 200, seed: int = 7) -> DataFrame:
    """repetition, mean: Poisson bootstrap, so each row takes part in each repetition by itself."""
    u = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col("repetition"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    times = sum((u >= c).cast("int") for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582))
    reps = df.select(key, value).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).withColumn("_t", times)
    return reps.groupBy("repetition").agg(F.try_divide(F.sum(F.col(value) * F.col("_t")), F.sum("_t")).alias("mean"))


def interval(df: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """mean, spread, median, and the values at places int(low n) and int(high n) of the sorted ones, by running counts of distinct values (null ones are skipped)."""
    counts = metrics.curve(df.select(*keys, F.col(value).alias("prediction"), F.lit(0).alias("label")), keys)
    # Values up to this one; the first beyond a place stands at it.
    upto = F.col("n_neg") - F.col("n_pred") + F.col("n")
    at = lambda q: F.min(F.when(upto > F.floor(F.col("n_neg") * q), F.col("threshold")))
    places = counts.groupBy(*keys).agg(at(low).alias("low"), at(high).alias("high"))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev(value).alias("spread"), F.median(value).alias("median")).join(places, keys)


def per_key_sample(df: DataFrame, key: str, id_col: str, n: int, seed: int = 7) -> DataFrame:
    """At most n rows of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(draw(seed, id_col), id_col))).filter(F.col("_k") <= n).drop("_k")


def round_robin(df: DataFrame, cluster: str, id_col: str, n: int) -> DataFrame:
    """n rows taken from the clusters by turns."""
    turn = F.row_number().over(Window.partitionBy(cluster).orderBy(id_col))
    return df.withColumn("turn", turn).orderBy("turn", cluster, id_col).limit(n)


def class_sample(items: DataFrame, n: int, uniform: bool = False, key: str = "item_id", label: str = "label", seed: int = 7) -> DataFrame:
    """About n rows: of each class in proportion to its size, or equally many of each (all, where it has fewer)."""
    sizes = items.groupBy(label).agg(F.count("*").alias("_n"))
    share = F.lit(n) / F.count("*").over(Window.partitionBy()) if uniform else F.lit(n) * F.col("_n") / F.sum("_n").over(Window.partitionBy())
    wanted = sizes.select(label, F.round(share).alias("_wanted"))
    ranks = numbered(items.withColumn("_seed", F.lit(seed)), [label], ["_seed", key], "_k")
    return ranks.join(wanted, label).filter(F.col("_k") < F.col("_wanted")).select(*items.columns)


def fold_and_dev(items: DataFrame, test_fold: int, folds: int, dev_ratio: float, key: str = "item_id", label: str = "label", seed: int = 7) -> DataFrame:
    """Adds split: test for one fold; of the rest, dev for the share that makes ``dev_ratio`` of all rows, exactly to rounding within each class."""
    ratio = dev_ratio / (1 - 1 / folds)
    rest = stratified_split(items.filter(F.col("fold") != test_fold), ratio, seed, key, label)
    rest = rest.withColumn("split", F.when(F.col("split") == "test", "dev").otherwise("train"))
    return rest.unionByName(items.filter(F.col("fold") == test_fold).withColumn("split", F.lit("test")))


def weighted_choice(df: DataFrame, keys: list[str], weight: str, id_col: str, seed: int = 7) -> DataFrame:
    """One row of each group, drawn in proportion to the weights; rows without a positive weight are never drawn."""
    # The least of exponential draws with these rates; a draw of 0 is moved off 0.
    wait = -F.ln(1 - draw(seed, *keys, id_col)) / F.col(weight)
    best = df.filter(F.col(weight) > 0).groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(wait, F.col(id_col))).alias("_r"))
    return best.select("_r.*")


def bootstrap_with_rest(df: DataFrame, key: str, repetitions: int, seed: int = 7) -> DataFrame:
    """Adds repetition and times: how often each row takes part in each repetition; rows with 0 are out of the bag."""
    u = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col("repetition"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    times = sum((u >= c).cast("int") for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582))
    return df.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).withColumn("times", times)
