"""The next member of an ensemble by several policies, combiners fitted out of fold, and non-negative weights.

Everything about rows is an aggregate per rater, per pair of raters or per fold; only such tables, whose size is that of the raters
squared, meet each other or come to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlake.operators import metrics
from raterlake.operators.sampling import draw


def candidates(ratings: DataFrame, ensemble: list[str]) -> DataFrame:
    """Each rater that the ensemble lacks: user_id, auc (its own), combined_auc (of the mean with the ensemble), correlation (absolute, with the
    ensemble's mean; 0 if one is constant)."""
    held, n = F.col("user_id").isin(ensemble), len(ensemble)
    mean = ratings.filter(held).groupBy("item_id").agg(F.avg("prediction").alias("_m"))
    rest = ratings.filter(~held).join(mean, "item_id")
    x, y = F.col("prediction"), F.col("_m")
    c = F.abs(F.try_divide(F.avg(x * y) - F.avg(x) * F.avg(y), F.stddev_pop(x) * F.stddev_pop(y)))
    rho = rest.groupBy("user_id").agg(F.round(F.coalesce(c, F.lit(0.0)), 6).alias("correlation"))
    together = rest.withColumn("prediction", F.round((y * n + x) / (n + 1), 9))
    own, both = (metrics.auc(r, ["user_id"]).select("user_id", F.round("auc", 6).alias(name)) for r, name in ((rest, "auc"), (together, "combined_auc")))
    return own.join(both, "user_id").join(rho, "user_id")


def by_combined_score(candidates: DataFrame, most: int = 50, seed: int = 7) -> DataFrame:
    """One row: of at most so many random candidates, the one with the best score together with the ensemble."""
    drawn = candidates.orderBy(draw(seed, "user_id"), "user_id").limit(most)
    return drawn.orderBy(F.desc("combined_auc"), "user_id").limit(1)


def by_diversity(candidates: DataFrame, least: int = 5) -> DataFrame:
    """One row: of the candidates least correlated with the ensemble, the one with the best score together with it."""
    return candidates.orderBy("correlation", "user_id").limit(least).orderBy(F.desc("combined_auc"), "user_id").limit(1)


def by_score_and_diversity(candidates: DataFrame, weight: float = 0.5) -> DataFrame:
    """One row: the candidate with the best weighted sum of its own score and its diversity."""
    value = F.round(weight * F.col("auc") + (1 - weight) * (1 - F.col("correlation")), 6)
    return candidates.orderBy(F.desc(value), "user_id").limit(1)


def out_of_fold(ratings: DataFrame) -> DataFrame:
    """fold, item_id, label, prediction: for each fold the scores weighted by the raters' correlation with the labels in all other folds.

    Sums per fold and rater are taken once; those of the other folds are the total less the fold's own.
    """
    x, y = F.col("prediction"), F.col("label").cast("double")
    sums = ratings.groupBy("fold", "user_id").agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"))
    w = Window.partitionBy("user_id")
    rest = sums.select("fold", "user_id", *((F.sum(c).over(w) - F.col(c)).alias(c) for c in ("n", "x", "y", "xy", "xx")))
    n = F.col("n")
    c = n * F.col("xy") - F.col("x") * F.col("y")
    s = F.sqrt(F.greatest(n * F.col("xx") - F.col("x") * F.col("x"), F.lit(0.0))) * F.sqrt(n * F.col("y") - F.col("y") * F.col("y"))
    weights = rest.select("fold", "user_id", F.when(s > 1e-9, c / s).otherwise(0.0).alias("weight"))
    joined = ratings.join(weights, ["fold", "user_id"])
    return joined.groupBy("fold", "item_id").agg(F.max("label").alias("label"), F.coalesce(F.try_divide(F.sum(F.col("weight") * x), F.sum(F.abs("weight"))), F.avg(x)).alias("prediction"))


def products(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, xy: sums of products of two raters' scores of the same items, a <= b; and of each with the label (b null)."""
    cell = F.struct("user_id", "prediction")
    items = ratings.groupBy(*keys, "item_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.max("label").alias("label"))
    one = items.select(*keys, "cells", "label", F.posexplode("cells").alias("i", "x"))
    label = F.struct(F.lit(None).cast("string").alias("user_id"), F.col("label").cast("double").alias("prediction"))
    others = F.concat(F.slice("cells", F.col("i") + 1, F.size("cells")), F.array(label))
    two = one.select(*keys, F.col("x.user_id").alias("a"), F.col("x.prediction").alias("_x"), F.explode(others).alias("y"))
    return two.groupBy(*keys, "a", F.col("y.user_id").alias("b")).agg(F.sum(F.col("_x") * F.col("y.prediction")).alias("xy"))


def nonnegative(gram: np.ndarray, target: np.ndarray, rounds: int = 10_000, tolerance: float = 1e-12) -> np.ndarray:
    """w >= 0 with the least w' gram w - 2 target' w, by coordinate descent. A rater without any score but 0 weighs 0."""
    w = np.zeros(len(target))
    for _ in range(rounds):
        moved = 0.0
        for k in np.flatnonzero(np.diag(gram) > 0):
            new = max(0.0, w[k] + (target[k] - gram[k] @ w) / gram[k, k])
            moved, w[k] = max(moved, abs(new - w[k])), new
        if moved <= tolerance:
            break
    return w


def nonnegative_weights(ratings: DataFrame) -> DataFrame:
    """fold, user_id, weight: the least-squares combination of raters with weights of 0 or more, fitted to the labels of all other folds. The
    driver gets one row for each fold and pair of raters."""
    rows = products(ratings, ["fold"]).collect()
    users = sorted({r["a"] for r in rows})
    folds = sorted({r["fold"] for r in rows})
    at, of = {u: k for k, u in enumerate(users)}, {f: k for k, f in enumerate(folds)}
    gram, target = np.zeros((len(folds), len(users), len(users))), np.zeros((len(folds), len(users)))
    for r in rows:
        f, a = of[r["fold"]], at[r["a"]]
        if r["b"] is None:
            target[f, a] = r["xy"]
        else:
            gram[f, a, at[r["b"]]] = gram[f, at[r["b"]], a] = r["xy"]
    out = []
    for fold in folds:
        w = nonnegative(gram.sum(axis=0) - gram[of[fold]], target.sum(axis=0) - target[of[fold]])
        out += [(fold, u, float(x)) for u, x in zip(users, w, strict=True)]
    return ratings.sparkSession.createDataFrame(out, "fold int, user_id string, weight double")


def stacked(ratings: DataFrame, weights: DataFrame) -> DataFrame:
    """fold, item_id, label, prediction: sums of scores by the weights of the item's fold."""
    return ratings.join(weights, ["fold", "user_id"]).groupBy("fold", "item_id").agg(F.max("label").alias("label"), F.sum(F.col("weight") * F.col("prediction")).alias("prediction"))
