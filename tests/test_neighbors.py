"""The best pairs of blocks, transfers and stacking by clusters against numpy."""

import numpy as np
import pandas as pd
import pytest

from raterlake.operators import cluster_stacking, similarity, topk


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "id long, vector array<double>")


def brute(q, p, k, by, not_itself):
    out = {}
    for i, a in enumerate(q):
        score = [(round(float(a @ b if by == "product" else ((a - b) ** 2).sum()), 6) * (-1 if by == "product" else 1), j) for j, b in enumerate(p) if not (not_itself and i == j)]
        out[i] = [(j, v) for v, j in sorted(score)[:k]]
    return out


@pytest.mark.parametrize("by", ["product", "distance"])
@pytest.mark.parametrize(("block", "k", "not_itself"), [(2048, 3, True), (7, 3, False), (7, 40, True), (1, 2, False)])
def test_best_pairs(spark, by, block, k, not_itself):
    rng = np.random.default_rng(2)
    # Few values, so many ties; and repeated vectors.
    p, q = rng.integers(-2, 3, (23, 4)) / 4, rng.integers(-2, 3, (11, 4)) / 4
    got = topk.best_pairs(frame(spark, range(11), q), frame(spark, range(23), p), k, by, not_itself, block).collect()
    rows = {i: [] for i in range(11)}
    for r in sorted(got, key=lambda r: r["rank"]):
        rows[r.query].append((r.neighbor, r.value * (-1 if by == "product" else 1)))
    want = brute(q, p, k, by, not_itself)
    assert {i: [j for j, _ in x] for i, x in rows.items()} == {i: [j for j, _ in x] for i, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for i in want for a, b in zip(rows[i], want[i], strict=True))
    assert all([r["rank"] for r in sorted(got, key=lambda r: r["rank"]) if r.query == i] == list(range(1, len(x) + 1)) for i, x in want.items())


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [1.0]), (4, [0.5, 0.5])], "id long, vector array<double>")
    got = topk.best_pairs(rows, rows, 5).collect()
    assert sorted((r.query, r.neighbor) for r in got) == [(1, 1), (1, 4), (4, 1), (4, 4)]
    assert topk.best_pairs(rows.limit(0), rows, 5).collect() == [] and topk.best_pairs(rows, rows.limit(0), 5).collect() == []


def test_no_pairs_in_the_plan(spark):
    rows = frame(spark, range(5), np.eye(5))
    plan = similarity.nearest(rows, rows, 2, "id", "id", "vector")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def ratings(spark, n, seed, first=0):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 2, n)
    cells = [(u, int(i) + first, float(np.clip(0.5 + w * (label[i] - 0.5) + rng.normal(0, 0.2), 0, 1)), int(label[i])) for u, w in {"a.0": 0.8, "a.1": 0.5, "b.0": 0.4, "c.0": 0.0}.items() for i in range(n)]
    return spark.createDataFrame(cells, "user_id string, item_id long, prediction double, label int")


USERS = ["a.0", "a.1", "b.0", "c.0"]


def wide(df):
    return df.toPandas().pivot_table(index="item_id", columns="user_id", values="prediction")[USERS]


def test_transfers(spark):
    known, new = ratings(spark, 30, 1), ratings(spark, 12, 2, first=100)
    r, t = wide(known), wide(new)
    s = (t.sub(t.mean(axis=1), axis=0)).to_numpy() @ (r.sub(r.mean(axis=1), axis=0)).to_numpy().T
    similar = topk.cross_similarity(new, known, USERS, 4)
    got = {(x.item_id, x["rank"]): (x.neighbor, x.similarity) for x in similar.collect()}
    factors = spark.createDataFrame([(int(i), [float(i), 1.0 / (1 + i)]) for i in r.index], "item_id long, f array<double>")
    f = {x.item_id: x.f for x in topk.transferred_factors(similar, factors, 2).collect()}
    cells = {(x.user_id, x.item_id): x.prediction for x in topk.transferred_cells(similar, known, "prediction").collect()}
    predicted = {(x.user_id, x.item_id): x.predicted for x in topk.predicted_new_items(new, known, similar).collect()}
    for j, item in enumerate(t.index):
        top = sorted(range(30), key=lambda i, j=j: (-round(s[j, i], 6), i))[:4]
        w = np.round(s[j, top], 6) + 1e-9
        assert [got[item, k + 1][0] for k in range(4)] == [r.index[i] for i in top]
        assert f[item] == pytest.approx([np.average(r.index[top], weights=w), np.average(1.0 / (1 + r.index[top].to_numpy()), weights=w)])
        for u in USERS:
            x = r[u].to_numpy()[top]
            assert cells[u, item] == pytest.approx(np.average(x, weights=w))
            assert predicted[u, item] == pytest.approx(t.loc[item].mean() + (w * (x - r.mean(axis=1).to_numpy()[top])).sum() / np.abs(w).sum())


def ridge(x, y, penalty):
    a = np.column_stack([np.ones(len(x)), x])
    p = penalty * np.eye(a.shape[1])
    p[0, 0] = 0
    w = np.linalg.solve(a.T @ a + p, a.T @ y)
    return lambda z: np.column_stack([np.ones(len(z)), z]) @ w


def test_stacking_by_clusters(spark):
    train, test = ratings(spark, 80, 3), ratings(spark, 25, 4, first=500)
    groups = {0: ["a.0", "a.1"], 1: ["b.0"], 2: ["c.0"]}
    clusters = spark.createDataFrame([(u, c) for c, us in groups.items() for u in us], "user_id string, cluster int")
    x, z = wide(train), wide(test)
    y = train.toPandas().groupby("item_id").label.max().to_numpy()
    inside = pd.DataFrame({c: ridge(x[us].to_numpy(), y, 1.0)(z[us].to_numpy()) for c, us in groups.items()}, index=z.index)
    got = cluster_stacking.stacked_inside(train, test, clusters).toPandas()
    assert len(got) == 75
    for r in got.itertuples():
        assert r.inside == pytest.approx(inside.loc[r.item_id, r.cluster]) and r.stacked == pytest.approx(inside.loc[r.item_id].mean())
    means = lambda d: np.column_stack([d[us].mean(axis=1) for us in groups.values()])
    want = pd.Series(ridge(means(x), y, 1.0)(means(z)), index=z.index)
    got = cluster_stacking.stacked_across(train, test, clusters).toPandas()
    assert len(got) == 25 and all(r.stacked == pytest.approx(want[r.item_id]) for r in got.itertuples())
    assert cluster_stacking.stacked_inside(train, test.limit(0), clusters).collect() == []


def test_clusters_of_raters(spark):
    rng = np.random.default_rng(8)
    one, two = rng.random(60), rng.random(60)
    cells = [(u, i, float(np.clip(base[i] + rng.normal(0, 0.02), 0, 1)), 1) for u, base in {"a": one, "b": one, "c": two, "d": two}.items() for i in range(60)]
    got = {r.user_id: r.cluster for r in cluster_stacking.rater_clusters(spark.createDataFrame(cells, "user_id string, item_id long, prediction double, label int"), 2).collect()}
    assert got["a"] == got["b"] != got["c"] == got["d"]


@pytest.mark.parametrize("by", ["product", "distance"])
def test_bounds_lose_no_point(monkeypatch, by):
    """Many groups and chunks: copies, ties, single and double precision, ids that stand twice."""
    monkeypatch.setattr(topk, "GROUP", 5)
    monkeypatch.setattr(topk, "CHUNK", 7)
    rng = np.random.default_rng(3)
    for turn, scale in enumerate((1e-4, 0.1, 1.0, 300.0)):
        p = rng.integers(-2, 3, (90, 3)) * scale / 4 if turn % 2 else rng.normal(0, scale, (90, 3))
        q, ids = p[rng.integers(0, 90, 40)], rng.permutation(90) // (1 + turn % 2)
        for not_itself in (False, True):
            rows, at, _ = topk.block_best(q, np.arange(40), p, ids, 4, by, not_itself)
            for i, a in enumerate(q):
                score = [(round(float(-(a * b).sum() if by == "product" else ((a - b) ** 2).sum()), 6) + 0.0, int(j)) for j, b in zip(ids, p, strict=True) if not (not_itself and i == j)]
                assert [int(j) for j in ids[at[rows == i]]] == [j for _, j in sorted(score)[:4]]


def test_few_products_where_vectors_have_few_dimensions(monkeypatch):
    """What is multiplied grows less than the points."""
    counted, product = [], np.matmul

    def matmul(a, b, **more):
        counted.append(a.shape[0] * b.shape[1])
        return product(a, b, **more)

    monkeypatch.setattr(np, "matmul", matmul)
    rng = np.random.default_rng(4)
    p, q = rng.normal(0, 1, (60_000, 3)), rng.normal(0, 1, (2000, 3))
    topk.block_best(q, np.arange(2000), p, np.arange(60_000), 3, "product", False)
    assert sum(counted) < 2000 * 60_000 / 5


def test_vectors_that_are_not_finite(spark):
    rows = frame(spark, range(4), [[1.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [0.5, 0.5]])
    got = topk.best_pairs(rows, rows, 1, "product").collect()
    assert sorted((r.query, r.neighbor) for r in got) == [(0, 0), (3, 0)]


def test_parts_are_recommended_by_blocks(spark):
    """Five parts for each customer, those with the largest products."""
    from raterlake.plans import queries

    made = queries.QUERIES["recommended_parts"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    got = made.toPandas()
    assert set(got.groupby("user").size()) == {5} and not got.duplicated(["user", "item"]).any()


def test_each_pair_of_blocks_has_a_task(spark):
    """Pairs are dealt by their number; by hashed keys several met in one task, and small partitions were put together."""
    rng = np.random.default_rng(5)
    rows = frame(spark, range(50), rng.normal(0, 1, (50, 4)))
    plan = topk.best_pairs(rows, rows, 2, "distance", True, 10)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 25)" in plan


@pytest.mark.parametrize("by", ["product", "distance"])
def test_vectors_without_structure(monkeypatch, by):
    """Bounds leave nothing out, so points are multiplied in their own order, and each counts once."""
    monkeypatch.setattr(topk, "GROUP", 16)
    monkeypatch.setattr(topk, "CHUNK", 27)
    kinds, compare = set(), np.less_equal
    monkeypatch.setattr(np, "less_equal", lambda a, b, **more: (kinds.add((a.dtype, b.dtype)), compare(a, b, **more))[1])
    rng = np.random.default_rng(6)
    p = rng.normal(0, 0.12, (400, 40))
    rows, at, values = topk.block_best(p[:50], np.arange(50), p, np.arange(400), 5, by, True)
    want = brute(p[:50], p, 5, by, True)
    assert all([int(j) for j in at[rows == i]] == [j for j, _ in want[i]] for i in range(50)) and len(at) == 250
    # In the precision of the products.
    assert kinds == {(np.dtype("float32"), np.dtype("float32"))}
