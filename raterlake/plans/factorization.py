"""Queries of factors: folding in, conjugate gradients, gradient descent. Fixed factors are given by formulas of ids where SQL is to follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from raterlake.operators import factorize, sgd
from raterlake.operators.state import stored
from raterlake.plans import workload as W
from raterlake.plans.queries import _R, query
from raterlake.plans.workload import with_ctes


def _formula(ids, key):
    """Two factors of each id."""
    part = lambda m: (F.col(key) % m + 1) / (m + 1.0)
    return ids.select(key).distinct().select(key, F.array(part(7), part(5)).alias("f"))


def _flat(df, key):
    return df.select(key, F.get("f", F.lit(0)).alias("f0"), F.get("f", F.lit(1)).alias("f1"))


@query(
    with_ctes(*_R)
    + """, f AS (SELECT user_id, prediction AS t, 1 + label AS w, (item_id % 7 + 1) / 8.0::DOUBLE AS a, (item_id % 5 + 1) / 6.0::DOUBLE AS b FROM ratings),
s AS (SELECT user_id, sum(w * a * a) + 0.1::DOUBLE AS aa, sum(w * a * b) AS ab, sum(w * b * b) + 0.1::DOUBLE AS bb, sum(w * t * a) AS ta, sum(w * t * b) AS tb FROM f GROUP BY user_id)
SELECT user_id, round((ta * bb - tb * ab) / (aa * bb - ab * ab), 6) AS f0, round((tb * aa - ta * ab) / (aa * bb - ab * ab), 6) AS f1 FROM s"""
)
def folded_in_raters(spark, sf_dir):
    """Factors of raters given those of items; positive items count double."""
    cells = W.ratings(spark, sf_dir).select("user_id", "item_id", F.col("prediction").alias("target"), (1.0 + F.col("label")).alias("weight"))
    return _flat(factorize.fold_in(cells, _formula(cells, "item_id"), "user", 2), "user_id")


@query(
    """WITH n AS (SELECT o_custkey AS user_id, l_partkey AS item_id, sum(l_quantity)::DOUBLE AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
f AS (SELECT item_id, (item_id % 7 + 1) / 8.0::DOUBLE AS a, (item_id % 5 + 1) / 6.0::DOUBLE AS b FROM (SELECT DISTINCT item_id FROM n)),
g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM f),
r AS (SELECT user_id, sum((n * 2 + 1) * a) AS ra, sum((n * 2 + 1) * b) AS rb FROM n JOIN f USING (item_id) GROUP BY user_id),
p AS (SELECT user_id, ra, rb, sum(n * 2 * (a * ra + b * rb) * a) AS pa, sum(n * 2 * (a * ra + b * rb) * b) AS pb FROM n JOIN f USING (item_id) JOIN r USING (user_id) GROUP BY ALL),
s AS (SELECT user_id, ra, rb, (ra * ra + rb * rb) / (ra * (pa + aa * ra + ab * rb + 0.1::DOUBLE * ra) + rb * (pb + ab * ra + bb * rb + 0.1::DOUBLE * rb)) AS alpha FROM p, g)
SELECT user_id, round(alpha * ra, 6) AS f0, round(alpha * rb, 6) AS f1 FROM s"""
)
def counted_gradient_step(spark, sf_dir):
    """Customers' factors after one step of conjugate gradients from zero, from how much they ordered of parts; parts not ordered count too."""
    cells = stored(W.purchases(spark, sf_dir).select(F.col("user").alias("user_id"), F.col("item").alias("item_id"), "n"))
    fixed = stored(_formula(cells, "item_id"))
    made = factorize.cg_half_step(factorize.counted_cells(cells, 2.0), fixed, None, "user_id", "item_id", 2, 0.1, 1, factorize.gram(fixed, 2))
    return _flat(made, "user_id")


@query()
def gradient_factors(spark, sf_dir):
    """Raters' factors by alternating conjugate gradients over all ratings."""
    cells = W.ratings(spark, sf_dir).select("user_id", "item_id", F.col("prediction").alias("target"), F.lit(1.0).alias("weight"))
    users, _ = factorize.als_cg(factorize.explicit_cells(cells), rank=2, iterations=2, steps=2)
    return _flat(users, "user_id")


@query()
def learning_curve(spark, sf_dir):
    """epoch, train_rmse, test_rmse of biased factors by gradient descent; fold 0 is the test."""
    cells = W.ratings(spark, sf_dir).withColumn("target", F.col("prediction"))
    model = sgd.fit(cells.filter("fold <> 0"), rank=2, epochs=3, test=cells.filter("fold = 0"))
    return spark.createDataFrame(model.curve, "epoch int, train_rmse double, test_rmse double")
