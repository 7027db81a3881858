"""Non-negative weights against all subsets of raters, and the neighbour and sampling operators on odd rows."""

from itertools import combinations

import numpy as np

from raterlake.operators import ensembles, sampling, similarity


def _best(x, y):
    """Least squares with weights of 0 or more: the best of the free solutions of all subsets that are non-negative."""
    best = (float(y @ y), np.zeros(x.shape[1]))
    for n in range(1, x.shape[1] + 1):
        for some in combinations(range(x.shape[1]), n):
            w = np.zeros(x.shape[1])
            w[list(some)] = np.linalg.lstsq(x[:, some], y, rcond=None)[0]
            if (w >= 0).all():
                best = min(best, (float(((x @ w - y) ** 2).sum()), w), key=lambda b: b[0])
    return best


def test_nonnegative_weights_are_the_best(spark):
    rng = np.random.default_rng(5)
    x = rng.random((60, 4))
    x[:, 3] = 0.0
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.random(60) > 0.1).astype(float)
    rows = [(f"u{u}", i, float(x[i, u]), int(y[i]), i % 3) for i in range(60) for u in range(4)]
    r = spark.createDataFrame(rows, "user_id string, item_id long, prediction double, label int, fold int")
    got = {(w["fold"], w["user_id"]): w["weight"] for w in ensembles.nonnegative_weights(r).collect()}
    for fold in range(3):
        rest = np.arange(60) % 3 != fold
        least, w = _best(x[rest], y[rest])
        mine = np.array([got[fold, f"u{u}"] for u in range(4)])
        assert abs(((x[rest] @ mine - y[rest]) ** 2).sum() - least) < 1e-6
        assert np.allclose(mine, w, atol=1e-4)


def test_class_sample_takes_all_of_a_small_class(spark):
    items = spark.createDataFrame([(i, int(i < 3)) for i in range(40)], "item_id long, label int")
    got = {r["label"]: r["count"] for r in sampling.class_sample(items, 20, uniform=True).groupBy("label").count().collect()}
    assert got == {0: 10, 1: 3}
    assert sampling.class_sample(items.limit(0), 20).count() == 0


def test_affinity_of_equal_points(spark):
    d = spark.createDataFrame([("a", "a", 0.0), ("a", "b", 0.0), ("b", "a", 0.0), ("b", "b", 0.0)], "a string, b string, distance double")
    got = {(r["a"], r["b"]): r["affinity"] for r in similarity.self_tuning_affinity(d, 1).collect()}
    assert got == {("a", "a"): 0.0, ("b", "b"): 0.0, ("a", "b"): 1.0, ("b", "a"): 1.0}


def test_matching_takes_exact_neighbours_first(spark):
    near = spark.createDataFrame([(0, 1), (0, 2)], "query long, neighbor long")
    voted = spark.createDataFrame([(0, "u", 1), (0, "v", 0)], "item_id long, user_id string, vote int")
    colored = spark.createDataFrame([(1, "u", -2), (1, "v", 1), (2, "u", 2), (2, "v", 1)], "item_id long, user_id string, color int")
    got = similarity.labels_by_matching(near, voted, colored).collect()[0]
    assert (got["exact"], got["distance"], got["predicted"]) == (1, 1, 0)
