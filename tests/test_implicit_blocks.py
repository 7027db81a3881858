"""MLlib's implicit ALS over blocks whose number grows with the ratings."""

import numpy as np
from pyspark.sql import functions as F

from raterlake.operators import factors


def counts(spark, n_users=40, n_items=30, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(u, i, float(rng.integers(1, 6))) for u in range(n_users) for i in range(n_items) if rng.random() < 0.5]
    return rows, spark.createDataFrame(rows, "user int, item int, n double")


def test_blocks_grow_with_the_ratings(spark, monkeypatch):
    """With ten blocks always, a task held a tenth of all ratings. All users and items get their factors, which solve the equations of the last half-step."""
    rows, table = counts(spark)
    monkeypatch.setattr(factors, "RATINGS", 25, raising=False)
    model = factors.implicit(table, rank=3, alpha=4.0)
    blocks = -(-len(rows) // 25)
    assert blocks > 10
    assert {side.rdd.getNumPartitions() for side in (model.userFactors, model.itemFactors)} == {blocks}
    x, y = ({r.id: np.array(r.features) for r in side.collect()} for side in (model.userFactors, model.itemFactors))
    assert set(x) == {u for u, _, _ in rows} and set(y) == {i for _, i, _ in rows}
    everywhere = sum(np.outer(f, f) for f in y.values())
    for user in x:
        own = [(y[i], 4.0 * n) for u, i, n in rows if u == user]
        left = everywhere + sum(c * np.outer(f, f) for f, c in own) + 0.1 * len(own) * np.eye(3)
        np.testing.assert_allclose(x[user], np.linalg.solve(left, sum((1 + c) * f for f, c in own)), atol=1e-4)


def test_ratings_are_made_once(spark):
    rows, table = counts(spark)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    # Sums over a shuffle, as the purchases are; these were made twice.
    sums = table.mapInPandas(count, table.schema).groupBy("user", "item").agg(F.sum("n").alias("n"))
    factors.implicit(sums, rank=2, iterations=1)
    assert made.value == len(rows)
