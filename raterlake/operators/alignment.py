"""How a filter of cells agrees with right and wrong cells, thresholds for it, and masks made with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.operators import metrics


def alignment(colors: DataFrame, keep: Column, keys: list[str], beta: float = 1.0) -> DataFrame:
    """Ratios of a filter (a 0/1 column) that keeps cells: aligned (of all), aligned_pos and aligned_neg (of right and wrong cells), positive
    (positives among aligned cells), f_beta of kept right cells, hit_to_miss (+1 on both sides), positive_hit_to_miss (for items with
    label 1), and fp_fn (kept errors of all kept cells, less is better)."""
    kept, right, pos = keep == 1, F.col("color") > 0, F.col("label") == 1
    n = {
        "_kr": F.count_if(kept & right),
        "_kw": F.count_if(kept & ~right),
        "_lr": F.count_if(~kept & right),
        "_lw": F.count_if(~kept & ~right),
        "_pk": F.count_if(kept & right & pos),
        "_pw": F.count_if(((kept & ~right) | (~kept & right)) & pos),
        "_pa": F.count_if((kept & right | ~kept & ~right) & pos),
    }
    c = colors.groupBy(*keys).agg(*(x.alias(k) for k, x in n.items()))
    kr, kw, lr, lw, pk, pw, pa = (F.col(k).cast("double") for k in n)
    b = beta**2
    return c.select(
        *keys,
        F.try_divide(kr + lw, kr + kw + lr + lw).alias("aligned"),
        F.try_divide(kr, kr + lr).alias("aligned_pos"),
        F.try_divide(lw, kw + lw).alias("aligned_neg"),
        F.try_divide(pa, kr + lw).alias("positive"),
        F.try_divide((1 + b) * kr, (1 + b) * kr + b * lr + kw).alias("f_beta"),
        ((kr + 1) / (kw + lr + 1)).alias("hit_to_miss"),
        ((pk + 1) / (pw + 1)).alias("positive_hit_to_miss"),
        F.try_divide(kw, kr + kw).alias("fp_fn"),
    )


def calibrated(cells: DataFrame, keys: list[str], score: str, steps: int = 100) -> DataFrame:
    """keys, threshold, aligned: the first of equally spaced thresholds at which keeping the cells that reach it agrees best with reliable
    (0/1), not below a twentieth of the range."""
    scored = cells.select(*keys, F.col(score).alias("prediction"), F.col("reliable").alias("label"))
    g = metrics.grid(scored, keys, 1.0 / steps, steps).filter(F.col("threshold") >= 0.05)
    aligned = F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 9)
    rows = g.withColumn("aligned", aligned)
    return rows.groupBy(*keys).agg(F.max_by("threshold", F.struct("aligned", -F.col("threshold"))).alias("threshold"), F.max("aligned").alias("aligned"))


def reliability_thresholds(colors: DataFrame) -> DataFrame:
    """user_id, r_th, balanced_accuracy: how far from its threshold a rater's score must be to be taken as right."""
    sure = colors.select("user_id", F.round(F.abs(F.col("prediction") - F.col("p_th")), 6).alias("prediction"), F.col("reliable").alias("label"))
    return metrics.balanced_threshold(sure, ["user_id"]).withColumnRenamed("threshold", "r_th")


def hardened(colors: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds trusted: 1 where the score is as far from its threshold as the rater's r_th."""
    rows = colors.join(thresholds.select("user_id", "r_th"), "user_id")
    return rows.withColumn("trusted", (F.round(F.abs(F.col("prediction") - F.col("p_th")), 6) >= F.col("r_th")).cast("int"))


def surest_users(cells: DataFrame, confidence: Column, ratio_users: float = 0.5) -> DataFrame:
    """Adds kept: 1 for the surest half (or other share, one at least) of each item's cells, smaller names among equals."""
    order = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(confidence), "user_id"))
    k = F.greatest(F.floor(F.count("*").over(Window.partitionBy("item_id")) * ratio_users), F.lit(1))
    return cells.withColumn("kept", (order <= k).cast("int"))


def mask_over(cells: DataFrame, keep: str, value: str, fill: float = 0.0) -> DataFrame:
    """Adds masked (the value of kept cells, else the fill) and its complement."""
    kept = F.col(keep) != 0
    return cells.withColumn("masked", F.when(kept, F.col(value)).otherwise(fill)).withColumn("complement", F.when(kept, fill).otherwise(F.col(value)))


def mask_profile(cells: DataFrame, keys: list[str], value: str, fill: float = 0.0) -> DataFrame:
    """keys, cells, masked, masked_ratio, effective: whether any cell is left."""
    masked = F.count_if(F.col(value) == fill)
    return cells.groupBy(*keys).agg(F.count("*").alias("cells"), masked.alias("masked"), (masked / F.count("*")).alias("masked_ratio"), F.bool_or(F.col(value) > fill).alias("effective"))


def without_neutral(cells: DataFrame, confidence: str) -> DataFrame:
    """Adds cp: the confidence of cells whose polarity isn't neutral, else 0."""
    return cells.withColumn("cp", F.when(F.col("polarity") != 0, F.col(confidence)).otherwise(0.0))
