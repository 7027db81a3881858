"""Votes, estimated labels, colours, reliability filters and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.functions import scalar


def votes(ratings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds p_th and vote by the thresholds of each user (user_id, p_th)."""
    return ratings.join(thresholds, "user_id").withColumn("vote", scalar.vote(F.col("prediction"), F.col("p_th")))


def majority(voted: DataFrame) -> DataFrame:
    """item_id, majority: the label most users vote for; the first user's vote on a tie."""
    counts = voted.groupBy("item_id").agg(F.count_if(F.col("vote") == 1).alias("ones"), F.count("*").alias("n"), F.min_by("vote", "user_id").alias("first"))
    return counts.select("item_id", F.when(F.col("ones") * 2 > F.col("n"), 1).when(F.col("ones") * 2 < F.col("n"), 0).otherwise(F.col("first")).alias("majority"))


def colored(voted: DataFrame) -> DataFrame:
    """Adds color, polarity, reliable (1 where vote and label agree) and reduced_color."""
    c = scalar.color(F.col("label"), F.col("vote"))
    return voted.withColumn("color", c).withColumns(
        {"polarity": scalar.polarity(F.col("color")), "reliable": scalar.preference(F.col("color")), "reduced_color": scalar.reduced_color(F.col("color"))}
    )


def agreeing_with_majority(voted: DataFrame) -> DataFrame:
    """Adds majority and agrees, a filter that needs no labels."""
    return voted.join(majority(voted), "item_id").withColumn("agrees", (F.col("vote") == F.col("majority")).cast("int"))


def color_counts(colors: DataFrame, keys: list[str]) -> DataFrame:
    """n of each colour for each key, zeros too."""
    codes = colors.sparkSession.createDataFrame([(2,), (1,), (-2,), (-1,), (0,)], "color int")
    frame = colors.select(*keys).distinct().crossJoin(F.broadcast(codes))
    return frame.join(colors.groupBy(*keys, "color").agg(F.count("*").alias("n")), [*keys, "color"], "left").na.fill(0, ["n"])


def color_violations(colors: DataFrame) -> DataFrame:
    """Items whose colours don't fit one label: all must be of (TP, FN) or all of (TN, FP)."""
    implied = F.collect_set(F.when(F.col("color") != 0, scalar.label_of_color(F.col("color"))))
    return colors.groupBy("item_id").agg(F.size(implied).alias("labels")).filter("labels > 1")


def labels_from_colors(colors: DataFrame) -> DataFrame:
    """item_id, label: 1 where a cell is TP or FN."""
    return colors.groupBy("item_id").agg(F.max(scalar.label_of_color(F.col("color"))).alias("label"))


def corrected_polarity(colors: DataFrame) -> DataFrame:
    """color_fixed: items with mixed colours moved to the side with more cells; ties stay."""
    w = Window.partitionBy("item_id")
    pos, neg = F.count_if(F.col("color").isin(2, -1)).over(w), F.count_if(F.col("color").isin(1, -2)).over(w)
    c = F.col("color")
    up = F.when(c == 1, -1).when(c == -2, 2).otherwise(c)
    down = F.when(c == 2, -2).when(c == -1, 1).otherwise(c)
    return colors.withColumn("color_fixed", F.when((pos > neg) & (neg > 0), up).when((neg > pos) & (pos > 0), down).otherwise(c))


def mask_color(colors: DataFrame, masked: list[int], marker: float = 0.0) -> DataFrame:
    """Scores of cells with these colours replaced by a marker."""
    return colors.withColumn("masked", F.when(F.col("color").isin(masked), F.lit(marker)).otherwise(F.col("prediction")))


def extreme_cells(ratings: DataFrame, k: int, by: str = "user_id") -> DataFrame:
    """Adds extreme: 1 for the k highest and k lowest scores of each user (or item). Each task passes on its own k on both sides only."""
    other = "item_id" if by == "user_id" else "user_id"
    best = lambda order: ratings.select("user_id", "item_id", F.row_number().over(Window.partitionBy(by).orderBy(order, other)).alias("_k")).filter(F.col("_k") <= k)
    found = best(F.desc("prediction")).union(best(F.asc("prediction"))).select("user_id", "item_id").distinct().withColumn("extreme", F.lit(1))
    return ratings.join(found, ["user_id", "item_id"], "left").na.fill(0, ["extreme"])


def kept_correct_cells(colors: DataFrame, ratio_users: float = 0.5) -> DataFrame:
    """kept: for each item 1 for up to half of its users that are right (surest first), -1 for wrong ones, else 0."""
    right = Window.partitionBy("item_id", "reliable").orderBy(F.desc(F.abs(F.col("prediction") - F.col("p_th"))), "user_id")
    n = F.count("*").over(Window.partitionBy("item_id"))
    k = F.greatest(F.floor(n * ratio_users), F.lit(1))
    return colors.withColumn("kept", F.when((F.col("reliable") == 1) & (F.row_number().over(right) <= k), 1).when(F.col("reliable") == 0, -1).otherwise(0))


def vote_pattern_probability(voted: DataFrame) -> DataFrame:
    """pattern, n, probability: the share of positives among items with the same votes of all users."""
    patterns = voted.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("user_id", "vote"))), lambda x: x["vote"].cast("string")), "").alias("pattern"), F.max("label").alias("label"))
    return patterns.groupBy("pattern").agg(F.count("*").alias("n"), F.avg("label").alias("probability"))


def class_prior(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """n, n_pos, n_neg, prior, minority class, its ratio, how many times larger the majority is, balanced."""
    c = items.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"))
    neg = F.col("n") - F.col("n_pos")
    small, large = F.least("n_pos", neg), F.greatest("n_pos", neg)
    return c.withColumns(
        {
            "n_neg": neg,
            "prior": F.col("n_pos") / F.col("n"),
            "min_class": F.when(F.col("n_pos") <= neg, 1).otherwise(0),
            "min_ratio": small / F.col("n"),
            "multiple": F.try_divide(large, small).cast("double"),
            "balanced": small / F.col("n") >= 0.1,
        }
    )


def filter_quality(colors: DataFrame, keep: Column, keys: list[str]) -> DataFrame:
    """How well a filter (a 0/1 column) keeps right cells: hits and misses, precision, recall, error rate, log hit-to-miss ratio."""
    kept, right = keep == 1, F.col("color") > 0
    c = colors.groupBy(*keys).agg(
        F.count_if(kept & right).alias("kept_right"), F.count_if(kept & ~right).alias("kept_wrong"), F.count_if(~kept & right).alias("lost_right"), F.count_if(~kept & ~right).alias("lost_wrong")
    )
    r, w, lr, lw = (F.col(x).cast("double") for x in ("kept_right", "kept_wrong", "lost_right", "lost_wrong"))
    return c.withColumns(
        {
            "filter_precision": F.try_divide(r, r + w),
            "filter_recall": F.try_divide(r, r + lr),
            "filter_error": F.try_divide(w + lr, r + w + lr + lw),
            "hit_to_miss": F.ln((r + lw + 1) / (w + lr + 1)),
        }
    )
