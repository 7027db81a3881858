"""Growing ensembles against a plain version, model by model, on rows with ties and a constant rater."""

import numpy as np
import pytest

from raterlake.operators import growth
from raterlake.operators.sampling import draw

USERS = [f"u{k}" for k in range(7)]


def _rows(seed=3, items=90):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, items)
    x = np.round(0.35 * y[:, None] + rng.random((items, 7)), 2)
    x[:, 1] = x[:, 0]
    x[:, 5] = 0.5
    x[:, 6] = np.round(1.35 - x[:, 2], 2)
    return x, y


@pytest.fixture(scope="module")
def ratings(spark):
    x, y = _rows()
    rows = [(u, i, float(x[i, k]), int(y[i]), i % 3) for i in range(len(y)) for k, u in enumerate(USERS)]
    return spark.createDataFrame(rows, "user_id string, item_id long, prediction double, label int, fold int").cache()


def _auc(p, y):
    p = np.round(p, 9)
    one, zero = p[y == 1][:, None], p[y == 0][None, :]
    return round(float(((one > zero) + (one == zero) / 2).mean()), 6)


def _fmax(p, y):
    p = np.round(p, 9)
    return round(max(2 * (y[p >= t].sum()) / ((p >= t).sum() + y.sum()) for t in np.unique(p)), 6)


def _likeness(x):
    n = x.shape[1]
    rho = np.zeros((n, n))
    for a in range(n):
        for b in range(n):
            if a != b and x[:, a].std() > 0 and x[:, b].std() > 0:
                rho[a, b] = round(abs(float(np.corrcoef(x[:, a], x[:, b])[0, 1])), 6)
    return rho


def _mean_likeness(rho, some):
    return round(float(np.mean([rho[a, b] for k, a in enumerate(some) for b in some[k + 1 :]])), 9)


def _grow(x, y, policy, initial, size, score, most, least, order):
    """order: the draw's number of each candidate at each step."""
    own = [score(x[:, k], y) for k in range(x.shape[1])]
    rho = _likeness(x)
    by_score = sorted(range(x.shape[1]), key=lambda k: (-own[k], k))
    chosen = by_score[: size if policy == "greedy" else initial]
    while len(chosen) < size and len(chosen) < x.shape[1]:
        rest = [k for k in range(x.shape[1]) if k not in chosen]
        if policy != "forward":
            rest = sorted(rest, key=lambda k: (order[len(chosen) + 1][k], k))[:most]
        together = {k: score(x[:, [*chosen, k]].mean(axis=1), y) for k in rest}
        alike = {k: _mean_likeness(rho, [*chosen, k]) for k in rest}
        if policy == "sdi":
            best = min(rest, key=lambda k: (-round(0.5 * own[k] + 0.5 * (1 - alike[k]), 9), k))
        else:
            rest = sorted(rest, key=lambda k: (alike[k], k))[:least] if policy == "drep" else rest
            best = min(rest, key=lambda k: (-together[k], k))
        chosen.append(best)
    return chosen


def _orders(spark, seed, folds, size):
    """The draws' numbers, by model, step and rater."""
    cells = spark.createDataFrame([(f, u) for f in range(folds) for u in USERS], "model int, user_id string")
    out = {f: {} for f in range(folds)}
    for step in range(1, size + 1):
        for r in cells.withColumn("d", draw(seed + step, "model", "user_id")).collect():
            out[r["model"]].setdefault(step, {})[USERS.index(r["user_id"])] = r["d"]
    return out


@pytest.mark.parametrize(("policy", "metric", "initial", "size"), [("greedy", "auc", 2, 5), ("forward", "fmax", 1, 4), ("enhanced", "auc", 1, 4), ("drep", "auc", 2, 5), ("sdi", "auc", 1, 7)])
def test_members_by_each_policy(spark, ratings, policy, metric, initial, size):
    x, y = _rows()
    orders = _orders(spark, 7, 3, size)
    got = growth.grown(ratings, policy, initial, size, metric, most=3, least=2).collect()
    for fold in range(3):
        rest = np.arange(len(y)) % 3 != fold
        want = _grow(x[rest], y[rest], policy, initial, size, _fmax if metric == "fmax" else _auc, 3, 2, orders[fold])
        assert [r["user_id"] for r in sorted(got, key=lambda r: r["step"]) if r["model"] == fold] == [USERS[k] for k in want]


def test_curve_and_held_out_scores(spark, ratings):
    x, y = _rows()
    members = growth.grown(ratings, "forward", 1, 4)
    curve = {(r["model"], r["step"]): r for r in growth.growth_curve(ratings, members).collect()}
    scores = {r["item_id"]: r for r in growth.held_out_scores(ratings, members).collect()}
    assert len(curve) == 12 and len(scores) == len(y)
    for fold in range(3):
        rest = np.arange(len(y)) % 3 != fold
        chosen = [USERS.index(curve[fold, s]["user_id"]) for s in range(1, 5)]
        rho, by_size = _likeness(x[rest]), []
        for s in range(1, 5):
            by_size.append(_auc(x[rest][:, chosen[:s]].mean(axis=1), y[rest]))
            assert curve[fold, s]["score"] == by_size[-1]
            assert curve[fold, s]["diversity"] == (None if s == 1 else pytest.approx(_mean_likeness(rho, chosen[:s]), abs=2e-9))
        best = int(np.argmax(by_size)) + 1
        for i in np.flatnonzero(~rest):
            assert scores[i]["size"] == best
            assert scores[i]["prediction"] == pytest.approx(x[i, chosen[:best]].mean(), abs=1e-9)


def test_odd_rows(spark, ratings):
    assert growth.grown(ratings.limit(0)).count() == 0
    with pytest.raises(ValueError):
        growth.grown(ratings, "best")
    # More members than raters: all of them, once each.
    some = ratings.filter("user_id < 'u3'")
    assert growth.grown(some, "forward", 1, 9).groupBy("model").count().filter("count <> 3").count() == 0
    # A rater without scores in a fold, and null scores, are passed over there.
    part = ratings.selectExpr("user_id", "item_id", "if(user_id = 'u0' AND fold <> 1, null, prediction) AS prediction", "label", "fold")
    got = growth.grown(part, "drep", 2, 7)
    assert got.filter("user_id = 'u0'").select("model").distinct().count() == 2
    assert growth.growth_curve(part, got).count() == got.count()
