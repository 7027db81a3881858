"""Splits, intervals and ranks where one class or rater holds most rows, against plain Python."""

import random

import pytest

from raterlake.operators import confidence, labels, reshape, sampling


@pytest.fixture(scope="module")
def cells(spark):
    draw = random.Random(1)
    rows = [("hot" if k % 4 else "rare", k, draw.randint(0, 20) / 20, int(k % 10 == 0)) for k in range(400)]
    return spark.createDataFrame([*rows, ("none", 1, None, 0)], "user_id string, item_id long, prediction double, label int"), rows


def test_average_ranks(cells):
    df, rows = cells
    got = {(r.user_id, r.item_id): r.average_rank for r in confidence.average_ranks(df).collect()}
    for u in ("hot", "rare"):
        own = sorted(p for x, _, p, _ in rows if x == u)
        for x, i, p, _ in rows:
            if x == u:
                assert got[u, i] == own.index(p) + (own.count(p) + 1) / 2
    assert got["none", 1] is None and len(got) == 401


def test_extreme_cells(cells):
    df, rows = cells
    got = {(r.user_id, r.item_id) for r in labels.extreme_cells(df.filter("prediction is not null"), 3).collect() if r.extreme}
    want = set()
    for u in ("hot", "rare"):
        own = [(p, i) for x, i, p, _ in rows if x == u]
        want |= {(u, i) for _, i in sorted(own)[:3]} | {(u, i) for _, i in sorted(own, key=lambda c: (-c[0], c[1]))[:3]}
    assert got == want


def test_intervals(cells):
    df, rows = cells
    for r in sampling.interval(df.filter("user_id <> 'none'"), ["user_id"], "prediction").collect():
        own = sorted(p for x, _, p, _ in rows if x == r.user_id)
        assert (r.low, r.high) == (own[int(0.05 * len(own))], own[int(0.95 * len(own))]) and r.mean == pytest.approx(sum(own) / len(own))


@pytest.mark.parametrize(("n", "parts"), [(10, 3), (9, 3), (2, 5), (0, 4)])
def test_near_equal_split(spark, n, parts):
    out = sampling.near_equal_split(spark.range(n).repartition(3), parts, "id").collect()
    sizes = [n // parts + (k < n % parts) for k in range(parts)]
    assert [r.part for r in sorted(out)] == [k + 1 for k in range(parts) for _ in range(sizes[k])]


def test_stratified_split(cells):
    df, _ = cells
    out = sampling.stratified_split(df.filter("prediction is not null"), 0.25).collect()
    count = lambda label, split: sum(r.label == label and r.split == split for r in out)
    assert (count(1, "test"), count(1, "train"), count(0, "test"), count(0, "train")) == (10, 30, 90, 270)
    # A class without a label is a class.
    none = df.limit(8).selectExpr("item_id", "cast(null as int) as label")
    assert sorted(r.split for r in sampling.stratified_split(none, 0.25).collect()) == ["test"] * 2 + ["train"] * 6
    other = sampling.stratified_split(df.filter("prediction is not null"), 0.25, seed=8).collect()
    assert {r.item_id for r in out if r.split == "test"} != {r.item_id for r in other if r.split == "test"}


def test_indices(cells):
    df, rows = cells
    out = reshape.with_indices(df).collect()
    assert {r.user_id: r.user_idx for r in out} == {"hot": 0, "none": 1, "rare": 2} and all(r.item_idx == r.item_id for r in out)
