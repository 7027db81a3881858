"""Undersampling, spectral clusters, ranks, and functions of strings and arrays against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterlake.functions import arrays
from raterlake.operators import spectral, undersampling
from raterlake.operators.numbering import ranked


def points(spark, n, seed):
    """Points on a small grid, so that distances tie, and some alike."""
    rng = np.random.default_rng(seed)
    v, label = rng.integers(0, 4, (n, 2)), (rng.random(n) < 0.3).astype(int)
    return spark.createDataFrame([(i, [float(x) for x in v[i]], int(label[i])) for i in range(n)], "id long, vector array<double>, label int"), v, label


def nearest(i, v, some, k):
    return sorted((j for j in some if j != i), key=lambda j: (((v[i] - v[j]) ** 2).sum(), j))[:k]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_miss(spark, seed):
    df, v, label = points(spark, 60, seed)
    few, many = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    close = {j for i in few for j in nearest(i, v, many, 3)}
    far = {j: round(float(np.mean([np.sqrt(((v[j] - v[i]) ** 2).sum()) for i in nearest(j, v, few, 3)])), 6) for j in close}
    want = set(few) | set(sorted(far, key=lambda j: (-far[j], j))[: len(few)])
    assert {r.id for r in undersampling.near_miss(df, 1).collect()} == want


@pytest.mark.parametrize("seed", [3, 4])
def test_cleaned(spark, seed):
    df, v, label = points(spark, 60, seed)
    near = {i: nearest(i, v, range(60), 3) for i in range(60)}
    outvoted = {i for i in near if 2 * sum(label[j] != label[i] for j in near[i]) > 3}
    gone = {i for i in outvoted if label[i] == 0} | {j for i in outvoted if label[i] == 1 for j in near[i] if label[j] == 0}
    assert {r.id for r in undersampling.cleaned(df, 1).collect()} == set(range(60)) - gone
    assert undersampling.cleaned(df.limit(0), 1).collect() == [] and undersampling.near_miss(df.limit(0), 1).collect() == []


def blocks(n, seed):
    """An affinity of three planted blocks with a few weak edges between them."""
    rng = np.random.default_rng(seed)
    truth = np.arange(n) % 3
    a = np.where(truth[:, None] == truth[None, :], rng.uniform(0.5, 1, (n, n)), np.where(rng.random((n, n)) < 0.1, 0.05, 0))
    a = np.triu(a, 1)
    return a + a.T, truth


def test_planted_blocks(spark):
    a, truth = blocks(36, 1)
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(36) for j in range(36) if a[i, j] > 0], "a long, b long, affinity double")
    rows, values = spectral.eigenvectors(edges, 3, tolerance=1e-6)
    d = a.sum(1)
    want, vectors = np.linalg.eigh(a / np.sqrt(d[:, None] * d[None, :]))
    assert np.allclose(values, want[::-1][:3], atol=1e-5)
    x = np.zeros((36, 3))
    for r in rows.collect():
        x[r.a] = r.x
    top = vectors[:, ::-1][:, :3]
    assert np.allclose(x.T @ x, np.eye(3), atol=1e-6) and np.allclose(x @ x.T, top @ top.T, atol=1e-4)
    got = {r.node: r.cluster for r in spectral.clusters(edges, 3).collect()}
    assert len({(truth[i], c) for i, c in got.items()}) == 3 == len(set(got.values()))


def test_affinity_of_neighbours(spark):
    df, v, _ = points(spark, 30, 5)
    got = {(r.a, r.b): r.affinity for r in spectral.neighbour_affinity(df.select("id", "vector"), 4).collect()}
    near = {i: nearest(i, v, range(30), 4) for i in range(30)}
    far = lambda i, j: float(((v[i] - v[j]) ** 2).sum())
    scale = {i: np.sqrt(far(i, near[i][-1])) for i in near}
    want = {(i, j) for i in near for j in near[i]} | {(j, i) for i in near for j in near[i]}
    assert got.keys() == want
    for i, j in want:
        assert got[i, j] == pytest.approx(np.exp(-far(i, j) / (scale[i] * scale[j])) if scale[i] * scale[j] else 1.0)


def test_neighbours_are_made_once(spark, monkeypatch):
    df, _, _ = points(spark, 30, 5)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    made = spectral.best_pairs
    monkeypatch.setattr(spectral, "best_pairs", lambda *a, **b: (lambda near: near.mapInArrow(counted, near.schema))(made(*a, **b)))
    assert spectral.normalised(spectral.neighbour_affinity(df.select("id", "vector"), 4)).count()
    assert seen.value == 30 * 4


def test_ranks_over_ranges(spark):
    rows = spark.range(3000).selectExpr("id", "id * 7919 % 101 as x").repartition(9)
    got = [r.id for r in sorted(ranked(rows, [F.desc("x"), F.asc("id")]).collect(), key=lambda r: r["rank"])]
    assert got == sorted(range(3000), key=lambda i: (-(i * 7919 % 101), i))
    assert ranked(rows.limit(0), [F.asc("id")]).collect() == []


def common(a, b):
    """The longest common run that ends first in a."""
    best = ""
    for end in range(1, len(a) + 1):
        for n in range(end, 0, -1):
            if a[end - n : end] in b:
                best = a[end - n : end] if n > len(best) else best
                break
    return best


def test_longest_common_substrings(spark):
    draw = random.Random(4)
    text = lambda: "".join(draw.choice("abcé世") for _ in range(draw.randint(0, 12)))
    pairs = [(text(), text()) for _ in range(150)] + [("", ""), ("a", ""), ("", "a"), ("same", "same")]
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    got = [r.x for r in df.select(arrays.longest_common_substring(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [*(common(a, b) for a, b in pairs), None, None]


@pytest.mark.parametrize("r", [0, 1, 2, 3, 5, 6])
def test_combinations(spark, r):
    df = spark.createDataFrame([(["a", "b", "b", None, "e"],), ([],)], "x array<string>")
    got = [[tuple(c) for c in row.c] for row in df.select(arrays.combinations(F.col("x"), r).alias("c")).collect()]
    assert got == [list(itertools.combinations(["a", "b", "b", None, "e"], r)), list(itertools.combinations([], r))]


def test_nested_maps(spark):
    df = spark.createDataFrame([({"b": {"y": 2, "x": 1}, "a": {}},)], "m map<string, map<string, int>>")
    assert [tuple(e) for e in df.select(arrays.nested_entries(F.col("m")).alias("e")).first().e] == [("b", "x", 1), ("b", "y", 2)]
