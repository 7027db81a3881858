"""Latent factors: weighted alternating least squares, predictions, errors, re-estimation.

A half-step solves, for each user, (sum w f f' + lambda I) x = sum w t f over its items' factors f with weights w and targets t. The sums
are plain aggregates with map-side partial sums, so a user or item with a third of all cells is as easy as any other; only the small
solve is done in Python, on one row for each user.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlake.functions import arrays
from raterlake.operators.state import stored

TARGETS = ("rating", "colored", "preference", "label")
#: Ratings of a block in MLlib's ALS on average, and blocks at least (MLlib's own number).
RATINGS, BLOCKS = 1 << 21, 10


def targets(cells: DataFrame, policy: str = "rating") -> DataFrame:
    """Adds target: the rating; 1 for TP and 0 for TN cells, else the rating; 1 for right cells, else 0; or the label."""
    t = {
        "rating": F.col("prediction"),
        "colored": F.when(F.col("color") == 2, 1.0).when(F.col("color") == 1, 0.0).otherwise(F.col("prediction")),
        "preference": F.when(F.col("color") > 0, 1.0).otherwise(0.0),
        "label": F.col("label").cast("double"),
    }[policy]
    return cells.withColumn("target", t)


def initial(cells: DataFrame, key: str, rank: int, seed: int) -> DataFrame:
    """Factors in [0.1, 0.9] from a hash of the key, so independent of partitions."""
    h = lambda k: (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed), F.lit(k)), F.lit(1000)) / 1000.0) * 0.8 + 0.1
    return cells.select(key).distinct().select(key, F.array(*(h(k) for k in range(rank))).alias("f"))


def half_step(cells: DataFrame, fixed: DataFrame, key: str, other: str, rank: int, reg: float) -> DataFrame:
    """Factors of key given those of the other side. cells: key, other, target, weight."""
    f = lambda i: F.get("f", F.lit(i))
    w, t = F.col("weight"), F.col("target")
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
    joined = cells.join(fixed, other)
    sums = joined.groupBy(key).agg(F.array(*(F.sum(w * f(i) * f(j)) for i, j in pairs)).alias("gram"), F.array(*(F.sum(w * t * f(i)) for i in range(rank))).alias("right"))

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, right: pd.Series) -> pd.Series:
        if not len(gram):
            return pd.Series([], dtype=object)
        sums_, a = np.stack(gram.to_list()), np.zeros((len(gram), rank, rank))
        for k, (i, j) in enumerate(pairs):
            a[:, i, j] = a[:, j, i] = sums_[:, k]
        return pd.Series(list(np.linalg.solve(a + reg * np.eye(rank), np.stack(right.to_list())[:, :, None])[:, :, 0]))

    return sums.select(key, solve("gram", "right").alias("f"))


def als(cells: DataFrame, rank: int = 4, iterations: int = 3, reg: float = 0.1, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """User and item factors (user_id, f) and (item_id, f) of cells with user_id, item_id, target, weight. Cells and each half-step's factors are written out, so
    the plan doesn't grow and no half-step makes the cells again."""
    cells = stored(cells)
    users = initial(cells, "user_id", rank, seed)
    items = initial(cells, "item_id", rank, seed + 1)
    for _ in range(iterations):
        items = stored(half_step(cells, users, "item_id", "user_id", rank, reg))
        users = stored(half_step(cells, items, "user_id", "item_id", rank, reg))
    return users, items


def predict(users: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds estimate, the dot product of both factors, to the pairs."""
    u, i = users.withColumnRenamed("f", "_u"), items.withColumnRenamed("f", "_i")
    return pairs.join(u, "user_id").join(i, "item_id").withColumn("estimate", arrays.dot(F.col("_u"), F.col("_i"))).drop("_u", "_i")


def errors(cells: DataFrame, estimate: str = "estimate", weight: Column | None = None) -> DataFrame:
    """One row: mse, rmse, mean absolute error and the weighted RMSE."""
    e = F.col("prediction") - F.col(estimate)
    w = F.col("weight") if weight is None else weight
    return cells.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(F.pow(w * e, F.lit(2)))).alias("weighted_rmse"))


def reestimate(cells: DataFrame, estimate: str = "estimate") -> DataFrame:
    """Adds renewed: right cells keep their score, all others take the estimate, clipped to [0, 1]."""
    return cells.withColumn("renewed", F.when(F.col("color") > 0, F.col("prediction")).otherwise(F.greatest(F.least(F.col(estimate), F.lit(1.0)), F.lit(0.0))))


def interpolate(a: Column, b: Column, weight: Column) -> Column:
    return weight * a + (1 - weight) * b


def factor_cost(users: DataFrame, items: DataFrame, cells: DataFrame, reg: float) -> DataFrame:
    """One row, cost: half the squared error over observed cells plus half the penalty of all factors."""
    e = predict(users, items, cells).agg(F.sum(F.pow(F.col("estimate") - F.col("prediction"), F.lit(2))).alias("e"))
    square = lambda d: d.agg(F.sum(arrays.dot(F.col("f"), F.col("f"))).alias("s"))
    u, i = square(users), square(items).withColumnRenamed("s", "t")
    return e.crossJoin(u).crossJoin(i).select((F.col("e") / 2 + reg / 2 * (F.col("s") + F.col("t"))).alias("cost"))


def implicit(counts: DataFrame, rank: int = 8, alpha: float = 40.0, iterations: int = 5, seed: int = 7):
    """MLlib's implicit ALS of (user, item, n); returns the model.

    A task of MLlib holds the ratings of a whole block of users or items several times over while it sorts them, and later the factors they refer to. So the number of blocks grows
    with the ratings. These are written out, as MLlib reads them more than once, and dealt by users' blocks, as a task keeps a buffer for each pair of blocks it
    meets. Each round ends with a checkpoint, after which its shuffles go. The first factors are drawn block by block, so they are others with another number of blocks.
    """
    from pyspark.ml.recommendation import ALS

    counts = stored(counts)
    blocks = max(BLOCKS, -(-counts.count() // RATINGS))
    dealt = counts.repartitionById(blocks, F.pmod("user", F.lit(blocks)).cast("int"))
    als_ = ALS(rank=rank, maxIter=iterations, alpha=alpha, implicitPrefs=True, userCol="user", itemCol="item", ratingCol="n", seed=seed, coldStartStrategy="drop")
    return als_.setNumBlocks(blocks).setCheckpointInterval(1).fit(dealt)


def stack(train: DataFrame, test: DataFrame, users: list[str]):
    """A logistic regression over the raters' scores (wide rows), and its probabilities on test: item_id, label, stacked."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = {u: u.replace(".", "_") for u in users}
    ready = lambda d: VectorAssembler(inputCols=list(names.values()), outputCol="features").transform(d.withColumnsRenamed(names).na.fill(0.0))
    model = LogisticRegression(regParam=0.01, maxIter=50).fit(ready(train))
    return model.transform(ready(test)).select("item_id", "label", F.get(vector_to_array("probability"), F.lit(1)).alias("stacked"))
