"""Wide, long and array forms of the rating relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlake.operators.numbering import ranked


def to_long(wide: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Wide level-1 rows (id, label, one column for each rater) as ratings."""
    ids = ids or ["id", "label"]
    users = [c for c in wide.columns if c not in ids]
    return wide.unpivot(ids, [f"`{u}`" for u in users] if any("." in u for u in users) else users, "user_id", "prediction").withColumnRenamed(ids[0], "item_id")


def to_wide(ratings: DataFrame, users: list[str]) -> DataFrame:
    """One row for each item with a column for each of the users, and the label."""
    return ratings.groupBy("item_id", "label").pivot("user_id", users).agg(F.first("prediction"))


def to_arrays(ratings: DataFrame) -> DataFrame:
    """One row for each user with its scores in the order of items."""
    return ratings.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "prediction"))), lambda x: x["prediction"]).alias("row"))


def from_arrays(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", F.posexplode("row").alias("item_idx", "prediction"))


def with_indices(ratings: DataFrame) -> DataFrame:
    """Adds user_idx and item_idx, dense codes from 0 in the order of ids (numbered over ranges)."""

    def codes(column: str, name: str) -> DataFrame:
        ids = ratings.select(column).distinct().filter(F.col(column).isNotNull())
        return ranked(ids, [F.asc(column)], name).withColumn(name, F.col(name) - 1)

    return ratings.join(codes("user_id", "user_idx"), "user_id").join(codes("item_id", "item_idx"), "item_id")


def masked_ratings(ratings: DataFrame, threshold: float = 0.5, missing: float = -1.0) -> DataFrame:
    """Scores on the wrong side of the threshold replaced by the missing value."""
    wrong = (F.col("prediction") >= threshold).cast("int") != F.col("label")
    return ratings.withColumn("rating", F.when(wrong, F.lit(missing)).otherwise(F.col("prediction")))


def split_at(ratings: DataFrame, fold: int) -> DataFrame:
    """Adds split: test for one fold, train for all others."""
    return ratings.withColumn("split", F.when(F.col("fold") == fold, "test").otherwise("train"))


def training_pairs(cells: DataFrame) -> DataFrame:
    """User, item, rating, weight (c0 of right cells) and colour of each cell."""
    return cells.select("user_id", "item_id", F.col("prediction").alias("rating"), F.when(F.col("color") > 0, F.col("c0")).otherwise(0.0).alias("weight"), "color")


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.select("*", *(F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values))


def label_agreement(ratings: DataFrame) -> DataFrame:
    """Items whose raters' rows hold more than one label; none in a consistent relation."""
    return ratings.groupBy("item_id").agg(F.count_distinct("label").alias("labels")).filter("labels > 1")


def label_matrix(ratings: DataFrame) -> DataFrame:
    """Each cell with its item's label as the rating."""
    return ratings.select("user_id", "item_id", F.col("label").alias("rating"), "split")


def class_codes(df: DataFrame, column: str, target: str) -> DataFrame:
    """Adds is_target (0/1), and code: the class's number from 0 in the order of its names (classes are few)."""
    classes = df.select(column).distinct()
    codes = classes.withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(codes, column).withColumn("is_target", (F.col(column) == target).cast("int"))
