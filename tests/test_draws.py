"""Draws and balanced cells against plain versions, and cells from clusters of items against all pairs of items."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterlake.operators import draws, item_clusters
from raterlake.operators.sampling import draw


def _cells(spark, n, ones):
    rows = [(u, i, i / n, int(i < ones), int((i + k) % 3 > 0)) for k, u in enumerate(("a", "b")) for i in range(n)]
    return spark.createDataFrame(rows, "user_id string, item_id long, prediction double, label int, vote int")


@pytest.mark.parametrize("multiple", [0.5, 1.5, 100])
def test_balanced_cells(spark, multiple):
    cells = _cells(spark, 60, 12)
    right = cells.toPandas().query("vote == label")
    got = draws.balanced_cells(cells, multiple=multiple).toPandas()
    assert got.merge(right, on=list(got.columns)).shape[0] == len(got) == len(got.drop_duplicates())
    for u, some in right.groupby("user_id"):
        ones, zeros = (some.label == 1).sum(), (some.label == 0).sum()
        mine = got[got.user_id == u]
        assert (mine.label == 1).sum() == ones and (mine.label == 0).sum() == min(zeros, int(ones * multiple))


def test_balanced_by_labels_with_and_without_replacement(spark):
    cells = _cells(spark, 60, 12)
    few = draws.balanced_by_labels(cells, 2).toPandas()
    assert set(few.times) == {1} and (few.label == 0).sum() == 48
    many = draws.balanced_by_labels(cells, 10).toPandas()
    zeros = many[many.label == 0]
    assert zeros.groupby("user_id").times.sum().tolist() == [120, 120] and zeros.times.max() > 1
    assert not zeros.duplicated(["user_id", "item_id"]).any() and (many[many.label == 1].times == 1).all()
    # The raters' draws differ; without a minority or a majority there is nothing to draw.
    a, b = (zeros[zeros.user_id == u].set_index("item_id").times for u in "ab")
    assert not a.sort_index().equals(b.sort_index())
    assert draws.balanced_by_labels(cells.filter("label = 0"), 10).count() == 0
    assert draws.balanced_by_labels(cells.filter("label = 1"), 10).count() == 24


def test_lifted_positives(spark):
    got = draws.lifted_positives(_cells(spark, 60, 12), 0.5, 0.1).toPandas()
    assert got[got.label == 1].prediction.between(0.6, 1).all() and got[got.label == 1].prediction.nunique() == 24
    assert (got[got.label == 0].prediction == got[got.label == 0].item_id / 60).all()


@pytest.mark.parametrize(("n", "parts"), [(17, 5), (20, 4), (3, 7), (1, 1)])
def test_intervals_and_their_samples(spark, n, parts):
    df = spark.createDataFrame([(i, (i * 7) % n // 2) for i in range(n)], "k long, x long")
    got = draws.in_intervals(df, ["x", "k"], parts).toPandas()
    ordered = sorted(zip(got.x, got.k, got.part, strict=True))
    for p in range(parts):
        want = ordered[p * n // parts : (p + 1) * n // parts]
        assert [t[2] for t in want] == [p] * len(want)
    sample = draws.interval_sample(df, ["x", "k"], parts, ["k"]).toPandas()
    assert sorted(sample.part) == sorted(set(got.part))
    assert sample.merge(got, on=["k", "x", "part"]).shape[0] == len(sample)
    assert draws.interval_sample(df.limit(0), ["x", "k"], parts, ["k"]).count() == 0


def test_weighted_draws_are_those_of_a_plain_search(spark):
    rng = np.random.default_rng(2)
    weights = np.concatenate((rng.random(300), [0.0, -1.0, 100.0]))
    df = spark.createDataFrame([(f"k{i}", float(w)) for i, w in enumerate(weights)] + [("none", None)], "k string, w double")
    got = draws.weighted_draws(df, "k", 2000, "w").toPandas().sort_values("draw")
    assert got.draw.tolist() == list(range(2000))
    rows = df.filter("w > 0").withColumn("h", F.xxhash64("k")).orderBy("h", "k").toPandas()
    ends = rows.w.cumsum().to_numpy()
    at = [r["u"] for r in spark.range(2000).select("id", draw(7, "id").alias("u")).orderBy("id").collect()]
    want = rows.k.to_numpy()[np.searchsorted(ends, np.array(at) * ends[-1], "right")]
    # Sums in another order may differ by rounding, at the border between two rows.
    assert (got.k.to_numpy() != want).sum() <= 1
    assert 0.3 < (got.k == "k302").mean() < 0.5
    assert not set(got.k) & {"k300", "k301", "none"}
    assert draws.weighted_draws(df.filter("w < 0"), "k", 5, "w").count() == 0


def test_density_draws_spread_like_the_kernel(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 10.0)], "k string, x double")
    got = draws.density_draws(df, "k", "x", 0.5, 4000).toPandas()
    for k, mean in (("a", 0.0), ("b", 10.0)):
        x = got[got.k == k].x
        assert abs(len(x) - 2000) < 200 and abs(x.mean() - mean) < 0.05 and abs(x.std() - 0.5) < 0.05


def test_negative_sample(spark):
    candidates = spark.createDataFrame([(i % 20,) for i in range(50)] + [(None,)], "k long").filter("k is not null")
    targets = spark.createDataFrame([(i,) for i in range(0, 20, 2)], "k long")
    some = [r["k"] for r in draws.negative_sample(candidates, targets, "k", 4).collect()]
    assert len(set(some)) == 4 and all(k % 2 for k in some)
    assert {r["k"] for r in draws.negative_sample(candidates, targets, "k", 99).collect()} == set(range(1, 20, 2))


def test_complete_bootstrap_holds_a_rare_class(spark):
    items = spark.createDataFrame([(i, int(i == 0)) for i in range(40)], "item_id long, label int")
    for seed in range(4):
        got = draws.complete_bootstrap(items, seed=seed).toPandas()
        assert set(got.label) == {0, 1} and got.repetition.nunique() == 1 and (got.times > 0).all()


def test_item_clusters_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.random((4, 30)), 3)
    x[:, 3] = 0.0
    clusters = rng.integers(0, 4, 30)
    rows = [(f"u{u}", i, float(x[u, i])) for u in range(4) for i in range(30)]
    r = spark.createDataFrame(rows, "user_id string, item_id long, prediction double")
    c = spark.createDataFrame([(i, int(k)) for i, k in enumerate(clusters)], "item_id long, cluster int")
    got = {(g["user_id"], g["item_id"]): g["predicted"] for g in item_clusters.predict_items_by_cluster(r, c, parts=3).collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=0), 1e-300)
    s = unit.T @ unit
    for i in range(30):
        near = np.flatnonzero(clusters == clusters[i])
        for u in range(4):
            if i == 3:
                assert got[f"u{u}", i] is None
            else:
                assert got[f"u{u}", i] == pytest.approx(s[i, near] @ x[u, near] / np.abs(s[i, near]).sum(), abs=1e-9)
    assert item_clusters.predict_items_by_cluster(r.limit(0), c).count() == 0
