"""Spectral clusters of a sparse affinity: its leading eigenvectors by orthogonal iteration, then k-means of their rows.

A step multiplies the normalised affinity with k vectors at once: each edge carries its neighbour's row of k numbers, and rows are added up by node with map-side
partial sums. Vectors are made orthonormal by the Cholesky factor of their products, a matrix as large as their number and the only thing that comes to the driver. Each
round's rows are written out, so plans don't grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlake.operators.similarity import self_tuning_affinity
from raterlake.operators.state import stored
from raterlake.operators.topk import best_pairs


def neighbour_affinity(points: DataFrame, k: int) -> DataFrame:
    """a, b, affinity between points (id, vector) one of which is among the k nearest of the other: exp(-d^2 / (s_a s_b)), s the distance to the k-th neighbour."""
    # Quadratic to make and read several times below, so it is made once.
    near = stored(best_pairs(points, points, k, "distance", not_itself=True).select(F.col("query").alias("a"), F.col("neighbor").alias("b"), F.sqrt("value").alias("distance"), "rank"))
    scale = near.filter(F.col("rank") == k).select("a", F.col("distance").alias("s"))
    both = near.select("a", "b", "distance").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).distinct()
    scaled = both.join(scale, "a").join(scale.select(F.col("a").alias("b"), F.col("s").alias("t")), "b")
    return scaled.select("a", "b", F.exp(-F.coalesce(F.try_divide(F.col("distance") * F.col("distance"), F.col("s") * F.col("t")), F.lit(0.0))).alias("affinity"))


def normalised(affinity: DataFrame) -> DataFrame:
    """a, b, w: the affinity over the roots of both nodes' degrees. a, b, affinity must hold both directions; nodes without weight fall out."""
    degree = affinity.groupBy("a").agg(F.sum("affinity").alias("d")).filter("d > 0")
    both = affinity.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    return both.select("a", "b", (F.col("affinity") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def _x(i: int) -> Column:
    return F.get("x", F.lit(i))


def _turned(rows: DataFrame, name: str, matrix: np.ndarray) -> DataFrame:
    """a, x: each row of ``name`` times a small matrix."""

    @F.pandas_udf("array<double>")
    def turn(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_list()) @ matrix) if len(x) else [], dtype=object)

    return rows.select("a", turn(name).alias("x"))


def _products(rows: DataFrame, one: str, other: str) -> np.ndarray:
    """The sum of the outer products of two columns of vectors; each task gives its own sum."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("one", "other"))
                total = total + x.T @ y
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "total"])

    parts = rows.select(F.col(one).alias("one"), F.col(other).alias("other")).mapInArrow(sums, "place long, total double")
    # As many rows as the product has entries.
    return np.array([r.total for r in parts.groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()])


def _times(edges: DataFrame, rows: DataFrame, m: int) -> DataFrame:
    """The matrix of the edges times x."""
    beside = edges.join(rows.select(F.col("a").alias("b"), "x"), "b")
    return beside.groupBy("a").agg(F.array(*(F.sum(F.col("w") * F.get("x", F.lit(i))) for i in range(m))).alias("x"))


def eigenvectors(affinity: DataFrame, k: int, tolerance: float = 1e-2, most: int = 60, spare: int = 4, inner: int = 3, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """a, x: the k leading eigenvectors of the normalised affinity, a row for each node, and their eigenvalues.

    ``spare`` vectors more speed up the convergence. A round multiplies ``inner`` times before the vectors are made orthonormal again, and solves the small problem
    within their span; it ends when no leading vector's image differs from its multiple by more than the tolerance, or after ``most`` rounds.
    """
    # Its degrees and both sides read it.
    edges = stored(normalised(stored(affinity)))
    nodes = edges.select("a").distinct()
    # Half of the matrix plus one, so that no eigenvalue is below zero.
    edges = stored(edges.select("a", "b", (F.col("w") / 2).alias("w")).unionByName(nodes.select("a", F.col("a").alias("b"), F.lit(0.5).alias("w"))))
    nodes = edges.select("a").distinct()
    m = min(k + spare, nodes.count())
    h = lambda i: F.pmod(F.xxhash64(F.col("a"), F.lit(seed), F.lit(i)), F.lit(2001)) / 1000.0 - 1.0
    rows = stored(nodes.select("a", F.array(*(h(i) for i in range(m))).alias("x")))
    rows = stored(_turned(rows, "x", np.linalg.inv(np.linalg.cholesky(_products(rows, "x", "x").reshape(m, m))).T))
    for turn in range(1, most + 1):
        moved = rows
        for _ in range(inner):
            moved = _times(edges, moved, m)
        both = stored(rows.join(moved.select("a", F.col("x").alias("y")), "a"))
        all_ = _products(both.select(F.concat("x", "y").alias("z"), "y"), "z", "y").reshape(2 * m, m)
        small, squares = (all_[:m] + all_[:m].T) / 2, all_[m:]
        values, turns = np.linalg.eigh(small)
        values, turns = values[::-1][:k], turns[:, ::-1][:, :k]
        apart = np.einsum("ij,ik,kj->j", turns, squares, turns) - values**2
        if turn == most or np.sqrt(np.maximum(apart, 0)).max() <= tolerance:
            break
        rows = _turned(both, "y", np.linalg.inv(np.linalg.cholesky(squares)).T)
    return _turned(both, "x", turns), 2 * np.maximum(values, 0) ** (1 / inner) - 1


def clusters(affinity: DataFrame, k: int, seed: int = 7, **limits) -> DataFrame:
    """node, cluster: k-means of the eigenvectors' rows at length one. limits: those of eigenvectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows, _ = eigenvectors(affinity, k, seed=seed, **limits)
    length = F.sqrt(sum((_x(i) * _x(i) for i in range(k)), F.lit(0.0)))
    unit = rows.select("a", F.array(*(F.try_divide(_x(i), length) for i in range(k))).alias("x"))
    points = stored(unit.select(F.col("a").alias("node"), F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))).alias("x"))).select("node", array_to_vector("x").alias("features"))
    return KMeans(k=k, seed=seed).fit(points).transform(points).select("node", F.col("prediction").alias("cluster"))


def rater_clusters(similarity_: DataFrame, k: int, neighbours: int = 3, **limits) -> DataFrame:
    """node, cluster of raters (a, b, similarity), from the self-tuning affinity of 1 - similarity."""
    apart = similarity_.select("a", "b", F.round(1 - F.col("similarity"), 9).alias("distance"))
    return clusters(self_tuning_affinity(apart, neighbours).filter("a <> b"), k, **limits)
