"""Bounds of products, made for many groups at once in the products' own precision."""

import numpy as np
import pytest

from raterlake.operators import topk


@pytest.mark.parametrize("scale", [1e-4, 0.1, 1.0, 300.0])
@pytest.mark.parametrize("copies", [False, True])
def test_bounds_of_many_groups_lose_no_point(monkeypatch, scale, copies):
    """More groups than are bounded at once, lengths that differ a lot, queries without a direction, ranks found by some of the points."""
    monkeypatch.setattr(topk, "GROUP", 4)
    monkeypatch.setattr(topk, "CHUNK", 300)
    rng = np.random.default_rng(11)
    p = rng.normal(0, scale, (40_000, 3)) * rng.choice([0.01, 0.3, 1.0], (40_000, 1))
    p = p[rng.integers(0, 900, 40_000)] if copies else p
    q, ids = rng.normal(0, scale, (150, 3)), rng.permutation(40_000)
    q[7] = 0.0
    rows, at, _ = topk.block_best(q, np.arange(150), p, ids, 5, "product", False)
    for i, a in enumerate(q):
        value = np.round(-(a * p).sum(1), 6) + 0.0
        assert ids[at[rows == i]].tolist() == ids[np.lexsort((ids, value))[:5]].tolist()


def test_bounds_are_made_for_many_groups_at_once(monkeypatch):
    """A group's bounds were products in double precision by themselves, the largest part of a pair of blocks."""
    kinds, product = [], np.matmul

    def matmul(a, b, **more):
        kinds.append((a.dtype, b.shape[1]))
        return product(a, b, **more)

    monkeypatch.setattr(np, "matmul", matmul)
    rng = np.random.default_rng(4)
    p, q = rng.normal(0, 0.1, (30_000, 3)), rng.normal(0, 1, (8192, 3))
    topk.block_best(q, np.arange(8192), p, np.arange(30_000), 3, "product", False)
    # 32 groups, 16 at once.
    assert [k for k, n in kinds if n == 30_000] == [np.dtype("float32")] * 2
