"""Folding in, conjugate gradients and stratified gradient descent against numpy."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterlake.operators import factorize, factors, sgd
from raterlake.operators.state import shared_folder

RANK = 3


@pytest.fixture(scope="module")
def cells(spark):
    """A third of all cells of rater 0, and items that few rate."""
    rng = np.random.default_rng(3)
    rows = {(int(u), int(i)) for u, i in rng.integers(0, [12, 30], (160, 2))} | {(0, i) for i in range(30)}
    x, y = rng.normal(0, 1, (12, 2)), rng.normal(0, 1, (30, 2))
    data = [(u, i, float(0.5 + 0.2 * x[u] @ y[i] + rng.normal(0, 0.02)), float(rng.integers(1, 4)), float(rng.integers(1, 9))) for u, i in sorted(rows)]
    return spark.createDataFrame(data, "user_id long, item_id long, target double, weight double, n double")


def vectors(df, key):
    return {r[key]: np.array(r.f) for r in df.collect()}


def solved(rows, key, other, fixed, reg, counts):
    """Exact factors of one side by numpy; rows: dicts with w and q."""
    g = sum((np.outer(f, f) for f in fixed.values()), np.zeros((RANK, RANK))) if counts else np.zeros((RANK, RANK))
    out = {}
    for k in {r[key] for r in rows}:
        mine = [r for r in rows if r[key] == k]
        a = g + reg * np.eye(RANK) + sum(r["w"] * np.outer(fixed[r[other]], fixed[r[other]]) for r in mine)
        out[k] = np.linalg.solve(a, sum(r["q"] * fixed[r[other]] for r in mine))
    return out


@pytest.mark.parametrize("counts", [False, True])
def test_enough_steps_are_exact(spark, cells, counts):
    ready = factorize.counted_cells(cells, 1.0) if counts else factorize.explicit_cells(cells)
    fixed, start = factors.initial(cells, "item_id", RANK, 1), factors.initial(cells, "user_id", RANK, 2)
    want = solved([r.asDict() for r in ready.collect()], "user_id", "item_id", vectors(fixed, "item_id"), 0.1, counts)
    matrix = factorize.gram(fixed, RANK) if counts else None
    for begin in (None, start, start.filter("user_id % 2 = 0")):
        got = vectors(factorize.cg_half_step(ready, fixed, begin, "user_id", "item_id", RANK, 0.1, RANK + 2, matrix), "user_id")
        assert got.keys() == want.keys()
        assert max(np.abs(got[k] - want[k]).max() for k in want) < 1e-6


def test_alternating_gradients_as_exact_steps(spark, cells):
    ready = factorize.explicit_cells(cells)
    users, items = factorize.als_cg(ready, RANK, 2, 0.1, RANK + 2, seed=5)
    rows = [r.asDict() for r in ready.collect()]
    x = vectors(factors.initial(cells, "user_id", RANK, 5), "user_id")
    for _ in range(2):
        y = solved(rows, "item_id", "user_id", x, 0.1, False)
        x = solved(rows, "user_id", "item_id", y, 0.1, False)
    for got, want in ((vectors(users, "user_id"), x), (vectors(items, "item_id"), y)):
        assert max(np.abs(got[k] - want[k]).max() for k in want) < 1e-6


def test_exact_half_steps(spark, cells):
    """The alternating least squares that were there before, by numpy."""
    users, items = factors.als(cells, RANK, 2, 0.1, 5)
    rows = [r.asDict() for r in factorize.explicit_cells(cells).collect()]
    x = vectors(factors.initial(cells, "user_id", RANK, 5), "user_id")
    for _ in range(2):
        y = solved(rows, "item_id", "user_id", x, 0.1, False)
        x = solved(rows, "user_id", "item_id", y, 0.1, False)
    got = vectors(users, "user_id")
    assert max(np.abs(got[k] - x[k]).max() for k in x) < 1e-8 and items.count() == len(y)


def test_plans_dont_grow_with_steps(spark, cells):
    ready, fixed = factorize.explicit_cells(cells), factors.initial(cells, "item_id", RANK, 1)
    sizes = [len(factorize.cg_half_step(ready, fixed, None, "user_id", "item_id", RANK, 0.1, k)._jdf.queryExecution().toString()) for k in (1, 5)]
    assert abs(sizes[0] - sizes[1]) < 200


def test_folding_in_is_a_half_step(spark, cells):
    folder = f"{shared_folder(spark)}/factors-{uuid.uuid4()}"
    old = cells.filter("user_id < 8")
    users, items = factors.als(old, RANK, 2)
    factorize.save_factors(folder, users, items)
    before = vectors(factorize.load_factors(spark, folder, "user", id_type="long"), "user_id")
    assert factorize.fold_in_new(spark, folder, cells, "user", RANK) == 1
    got = vectors(factorize.load_factors(spark, folder, "user", id_type="long"), "user_id")
    fixed = factorize.load_factors(spark, folder, "item", id_type="long")
    whole = vectors(factors.half_step(cells, fixed, "user_id", "item_id", RANK, 0.1), "user_id")
    new = {r.user_id for r in cells.filter("user_id >= 8").select("user_id").distinct().collect()}
    assert got.keys() == before.keys() | new
    assert all(np.allclose(got[k], whole[k], atol=1e-9) for k in new) and all((got[k] == before[k]).all() for k in before)
    # The new version holds the new ids alone, and the old one can still be read.
    assert spark.read.parquet(folder).filter("version = 1").count() == len(new)
    assert vectors(factorize.load_factors(spark, folder, "user", 0, "long"), "user_id").keys() == before.keys()
    assert factorize.fold_in_new(spark, folder, cells, "user", RANK) == 1 and spark.read.parquet(folder).filter("version > 1").count() == 0
    # Items that no old rater knows are folded in from the raters of the newest version.
    more = cells.unionByName(cells.limit(1).withColumn("item_id", F.lit(99).cast("long")))
    factorize.fold_in_new(spark, folder, more, "item", RANK)
    assert 99 in vectors(factorize.load_factors(spark, folder, "item", id_type="long"), "item_id")


def test_odd_cells(spark, cells):
    none = cells.limit(0)
    assert factorize.fold_in(none, factors.initial(cells, "item_id", RANK, 1), "user", RANK).collect() == []
    ready = factorize.explicit_cells(none)
    assert factorize.cg_half_step(ready, factors.initial(cells, "item_id", RANK, 1), None, "user_id", "item_id", RANK, 0.1, 2).collect() == []
    # Weights of zero leave nothing to move for.
    flat = factorize.explicit_cells(cells.withColumn("weight", F.lit(0.0)))
    got = vectors(factorize.cg_half_step(flat, factors.initial(cells, "item_id", RANK, 1), None, "user_id", "item_id", RANK, 0.1, 3), "user_id")
    assert all((v == 0).all() for v in got.values())


def numpy_descent(train, rank, epochs, rate, reg):
    """Plain descent, a cell at a time, in the order of rows; the errors after each epoch."""
    rng = np.random.default_rng(0)
    mean = np.mean([t for _, _, t in train])
    n_u, n_i = 1 + max(u for u, _, _ in train), 1 + max(i for _, i, _ in train)
    bu, bi, x, y = np.zeros(n_u), np.zeros(n_i), rng.uniform(-0.1, 0.1, (n_u, rank)), rng.uniform(-0.1, 0.1, (n_i, rank))
    out = []
    for _ in range(epochs):
        for u, i, t in train:
            e = t - mean - bu[u] - bi[i] - x[u] @ y[i]
            bu[u] += rate * (e - reg * bu[u])
            bi[i] += rate * (e - reg * bi[i])
            x[u], y[i] = x[u] + rate * (e * y[i] - reg * x[u]), y[i] + rate * (e * x[u] - reg * y[i])
        out.append(np.sqrt(np.mean([(t - mean - bu[u] - bi[i] - x[u] @ y[i]) ** 2 for u, i, t in train])))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_descent(spark, cells, block):
    test = cells.filter("item_id % 10 = 1").unionByName(cells.limit(1).withColumn("user_id", F.lit(77).cast("long")))
    model = sgd.fit(cells, rank=2, epochs=4, rate=0.05, reg=0.01, test=test, block=block)
    errors = [e for _, e, _ in model.curve]
    assert [k for k, _, _ in model.curve] == [0, 1, 2, 3, 4] and errors == sorted(errors, reverse=True)
    plain = numpy_descent([(r.user_id, r.item_id, r.target) for r in cells.collect()], 2, 4, 0.05, 0.01)
    assert errors[-1] < 1.05 * plain[-1]
    assert model.users.count() == 12 and model.items.count() == cells.select("item_id").distinct().count()
    assert model.predict(test).filter("user_id = 77 AND estimate IS NOT NULL").count() == 1


def test_strata_dont_meet(spark, cells):
    blocks = sgd.number_of_blocks(cells, 60)
    assert blocks > 1
    dealt = cells.withColumn("ub", sgd._block("user_id", blocks)).withColumn("ib", sgd._block("item_id", blocks)).withColumn("s", F.pmod(F.col("ib") - F.col("ub"), F.lit(blocks)))
    assert dealt.groupBy("ub", "ib").count().filter("count > 60").count() == 0
    for key, block in (("user_id", "ub"), ("item_id", "ib")):
        assert dealt.groupBy("s", key).agg(F.count_distinct("ub").alias("n")).filter("n > 1").count() == 0
        assert dealt.groupBy(key).agg(F.count_distinct(block).alias("n")).filter("n > 1").count() == 0
