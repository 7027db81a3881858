"""Factors of a whole grid of parameters on all folds at once, and the choice among them.

A model is a row of the grid on the cells outside one part. Its number and the part are two more keys of every join and sum, so the plan of a half-step, and the number of
jobs, are the same for one model and for a hundred. Factors are as long as the largest rank; those of smaller ranks end in zeros, which no step changes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlake.functions import arrays
from raterlake.operators import factors
from raterlake.operators.state import stored

KEYS = ["model", "part"]


def _half_step(cells: DataFrame, fixed: DataFrame, key: str, other: str, rank: int) -> DataFrame:
    """model, part, key, f given the other side's factors. cells: model, part, reg, key, other, target, weight."""
    f = lambda i: F.get("f", F.lit(i))
    w, t = F.col("weight"), F.col("target")
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
    sums = cells.join(fixed, [*KEYS, other]).groupBy(*KEYS, key, "reg").agg(F.array(*(F.sum(w * f(i) * f(j)) for i, j in pairs)).alias("gram"), F.array(*(F.sum(w * t * f(i)) for i in range(rank))).alias("right"))

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, right: pd.Series, reg: pd.Series) -> pd.Series:
        if not len(gram):
            return pd.Series([], dtype=object)
        sums_, a = np.stack(gram.to_list()), np.zeros((len(gram), rank, rank))
        for k, (i, j) in enumerate(pairs):
            a[:, i, j] = a[:, j, i] = sums_[:, k]
        a += reg.to_numpy()[:, None, None] * np.eye(rank)
        return pd.Series(list(np.linalg.solve(a, np.stack(right.to_list())[:, :, None])[:, :, 0]))

    return sums.select(*KEYS, key, solve("gram", "right", "reg").alias("f"))


def dev_scores(cells: DataFrame, grid: list[dict], iterations: int = 3, seed: int = 7) -> DataFrame:
    """model, rank, reg, part, rmse, n: for each row of the grid (rank, and reg over 0) and each part the error, on the part's cells, of factors trained on the cells of all other parts.

    cells: user_id, item_id, part, target, weight. Cells whose rater or item no other part knows aren't scored; n counts those that are.
    """
    spark, rank = cells.sparkSession, max(g["rank"] for g in grid)
    models = spark.createDataFrame([(k, int(g["rank"]), float(g["reg"])) for k, g in enumerate(grid)], "model int, rank int, reg double")
    # As many copies of the cells as the grid and the parts ask for.
    parts = cells.select("part").distinct()
    runs = models.join(F.broadcast(parts))
    cells = cells.select("user_id", "item_id", F.col("part").alias("_own"), "target", "weight")
    train = stored(cells.join(F.broadcast(runs), F.col("_own") != F.col("part")).drop("_own"))

    def begin(key: str, s: int) -> DataFrame:
        ids = factors.initial(cells, key, rank, s).join(F.broadcast(runs.select(*KEYS, "rank")))
        return stored(ids.select(*KEYS, key, F.transform("f", lambda x, i: F.when(i < F.col("rank"), x).otherwise(0.0)).alias("f")))

    users = begin("user_id", seed)
    for _ in range(iterations):
        items = stored(_half_step(train, users, "item_id", "user_id", rank))
        users = stored(_half_step(train, items, "user_id", "item_id", rank))
    held = cells.withColumnRenamed("_own", "part").join(F.broadcast(runs), "part")
    joined = held.join(users.withColumnRenamed("f", "_u"), [*KEYS, "user_id"]).join(items.withColumnRenamed("f", "_i"), [*KEYS, "item_id"])
    error = F.col("target") - arrays.dot(F.col("_u"), F.col("_i"))
    return joined.groupBy("model", "rank", "reg", "part").agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count("*").alias("n"))


def chosen(scores: DataFrame, by: str = "mean") -> DataFrame:
    """One row, model and its rank, reg, mean_rmse and wins: the one with the least mean error over parts, or (by "frequency") the one that is best in most parts. Equal models by the
    other measure, then by number."""
    best = F.row_number().over(Window.partitionBy("part").orderBy("rmse", "model")) == 1
    each = scores.withColumn("_best", best).groupBy("model", "rank", "reg").agg(F.round(F.avg("rmse"), 9).alias("mean_rmse"), F.count_if("_best").alias("wins"))
    order = [F.asc("mean_rmse"), F.desc("wins")] if by == "mean" else [F.desc("wins"), F.asc("mean_rmse")]
    return each.orderBy(*order, "model").limit(1)
