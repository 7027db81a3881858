"""Scalar expressions on scores, votes, colours and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed codes of a cell: its vote against the item's label.
TP, TN, FP, FN, UNKNOWN = 2, 1, -2, -1, 0


def vote(prediction: Column, threshold: Column | float) -> Column:
    """1 where the score reaches the threshold."""
    return (prediction >= threshold).cast("int")


def color(label: Column, vote: Column) -> Column:
    """TP, TN, FP or FN; unknown where either is null."""
    return (
        F.when((label == 1) & (vote == 1), TP)
        .when((label == 0) & (vote == 0), TN)
        .when((label == 0) & (vote == 1), FP)
        .when((label == 1) & (vote == 0), FN)
        .otherwise(UNKNOWN)
    )


def reduced_color(color: Column) -> Column:
    """Both kinds of error as -1."""
    return F.when(color < 0, -1).otherwise(color)


def polarity(color: Column) -> Column:
    """1 for right cells, -1 for wrong ones, 0 for unknown ones."""
    return F.signum(color).cast("int")


def preference(color: Column) -> Column:
    """1 for right cells, else 0."""
    return (color > 0).cast("int")


def preference_to_polarity(p: Column) -> Column:
    return F.when(p == 1, 1).otherwise(-1)


def polarity_to_preference(p: Column, neutral: float = 0.0) -> Column:
    return F.when(p > 0, 1.0).when(p < 0, 0.0).otherwise(neutral)


def label_of_color(color: Column) -> Column:
    """The label that a cell's colour implies."""
    return color.isin(TP, FN).cast("int")


def clip_probability(x: Column, epsilon: float = 1e-9) -> Column:
    """Values outside [0, 1] moved just inside."""
    return F.when(x > 1, 1 - epsilon).when(x < 0, epsilon).otherwise(x)


def binarize(x: Column, threshold: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x >= threshold, high).otherwise(low)


def affinity(similarity: Column, sigma: float = 0.5) -> Column:
    return F.exp(-F.pow(1 - similarity, 2) / (2 * sigma**2))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    return F.try_divide((1 + beta**2) * precision * recall, beta**2 * precision + recall)


def family(user_id: Column) -> Column:
    """The rater's name without its bag."""
    return F.regexp_replace(user_id, r"\.[^.]*$", "")


def bag(user_id: Column) -> Column:
    return F.try_element_at(F.split(user_id, r"\."), F.lit(-1)).try_cast("int")


def name_part(name: Column, k: int, default: str = "") -> Column:
    """The k-th part of a name such as ``model+F120``."""
    return F.coalesce(F.get(F.split(name, r"\+"), F.lit(k)), F.lit(default))


def parse_list(text: Column, sep: str = ",") -> Column:
    return F.filter(F.transform(F.split(text, sep), F.trim), lambda x: x != "")


def parse_pairs(text: Column, sep: str = ",", eq: str = "=") -> Column:
    return F.str_to_map(F.regexp_replace(text, r"\s+", ""), F.lit(sep), F.lit(eq))


def coerce_number(text: Column) -> Column:
    """The number that a text spells, or null."""
    return text.try_cast("double")


def near_equal_parts(total: int, parts: int) -> Column:
    """A total split into integers that differ by one at most, larger ones first."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: (F.lit(total // parts) + (i < total % parts).cast("int")).cast("int"))


def metric_of_policy(policy: Column) -> Column:
    """The metric that a threshold policy optimises."""
    return F.when(policy == "fmax", "fmax").when(policy == "auc", "auc").when(policy.isin("balanced", "acc"), "balanced_accuracy").otherwise("fmax")


def higher_is_better(metric: Column) -> Column:
    return ~F.lower(metric).rlike("loss|mse|error")


def is_user_dim(name: Column, setting: Column) -> Column:
    """Whether a dimension's name and an even setting say that it is the raters'."""
    return (name.startswith("u") | name.startswith("cl")) & (setting % 2 == 0)


def is_item_dim(name: Column, setting: Column) -> Column:
    """Whether a dimension's name and an odd setting say that it is the items'."""
    return (name.startswith("i") | name.startswith("sa") | name.startswith("da")) & (setting % 2 == 1)


def select_k(n: Column, k: float) -> Column:
    """A share of n rounded up for k between 0 and 1, else k or n, whichever is less."""
    return (F.ceil(n * k) if 0 < k < 1 else F.least(F.lit(int(k)), n)).cast("int")


def scope(x: Column, low: float, high: float) -> Column:
    """below, within or above two bounds, which are within."""
    return F.when(x < low, "below").when(x > high, "above").otherwise("within")
