"""The best k of a product of two sets of vectors, block by block, and what is carried over from neighbours.

Queries and points are dealt over blocks. Each pair of blocks meets once as two matrices in a task, which gives only the k best points of each
of its queries; the k best of these are the result. So no pair of rows is ever a row of a plan, and a task holds two blocks, whatever the sizes of both sides.

Within a task, queries that lie close together make a group. How far a point can get with any of a group's queries is bounded by the triangle inequality from the group's centre
and radius; points come in the order of this bound, and the rest is left out once it lies behind the group's k-th values. So all points count, but vectors of few
dimensions are multiplied with few of them. Vectors without structure are multiplied with all: that is quadratic by nature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterlake.operators.state import stored

#: Rows of a block at least; numbers of a block of queries and of points at most. With fewer than SPREAD pairs of blocks, those of queries are smaller.
BLOCK, QUERIES, POINTS, SPREAD = 2048, 1 << 21, 1 << 22, 64
#: Queries that share a bound, points that are multiplied at once, and groups whose bounds are made at once.
GROUP, CHUNK, AHEAD = 256, 2048, 16
#: Digits by which products and distances are compared.
DIGITS = 6


def _groups(vectors: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of vectors that lie close together: halves along the widest dimension, until they are small enough."""
    parts, out = [np.arange(len(vectors))], []
    while parts:
        part = parts.pop()
        if len(part) <= size:
            out.append(part)
            continue
        some = vectors[part]
        half = np.argpartition(some[:, some.std(0).argmax()], len(part) // 2)
        parts += [part[half[: len(part) // 2]], part[half[len(part) // 2 :]]]
    return out


def _without_copies(vectors: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the points, of equal vectors only the ``keep`` smallest ids."""
    odd = np.random.default_rng(7).integers(1, 2**63, vectors.shape[1], dtype=np.uint64) | np.uint64(1)
    hashed = np.zeros(len(vectors), np.uint64)
    for i, factor in enumerate(odd):
        hashed += pd.util.hash_array(vectors[:, i]) * factor
    order = np.lexsort((ids, hashed))
    heads = np.flatnonzero(np.concatenate(([True], hashed[order][1:] != hashed[order][:-1])))
    run = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    late = np.arange(len(order)) - heads[run] >= keep
    # Of a run of one hash, only if all its vectors are equal.
    some = np.flatnonzero(np.isin(run, run[late]))
    other = run[some[(vectors[order[some]] != vectors[order[heads[run[some]]]]).any(1)]]
    return order[~late | np.isin(run, other)]


def _first_of(rows: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each row by value and id, row by row."""
    order = np.lexsort((ids, values, rows))
    sorted_ = rows[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < k]


def block_best(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int, by: str, not_itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of their k best points, and the values: products with the sign turned, or squared distances. Smaller ids first among equals."""
    # How often an id stands among the points: so many more of equal ones may be left out as the query itself.
    again = int(np.unique(p_ids, return_counts=True)[1].max(initial=0)) if not_itself else 0
    kept = _without_copies(p, p_ids, k + again)
    if len(kept) < len(p):
        p, p_ids = p[kept], p_ids[kept]
    else:
        kept = np.arange(len(p))
    q2, p2 = (q * q).sum(1), (p * p).sum(1)
    # Sums and products of single precision find candidates with a margin for rounding; values are of double precision.
    scale = q2.max(initial=0) + p2.max(initial=0)
    kind = np.float32 if scale < 1e3 else np.float64
    margin = 10.0**-DIGITS + (p.shape[1] + 8) * np.finfo(kind).eps * 2 * scale
    far = by == "distance"
    # The smaller the better: a product turned, or a squared distance without the query's own part.
    left = np.column_stack([q, np.full(len(q), float(far))]).astype(kind)
    right = np.column_stack([-2 * p, p2] if far else [-p, np.sqrt(p2)]).astype(kind)
    own = q2 if far else np.zeros(len(q))
    norms = np.ones(len(q)) if far else np.sqrt(q2)
    # Written over again and again, as new memory costs more than the products.
    room, flags = np.empty(GROUP * CHUNK, kind), np.empty(GROUP * CHUNK + 8, bool)
    place = q if far else q / np.where(norms > 0, norms, 1.0)[:, None]
    # Bounds of products are of the products' precision too: centres and radii are 2 at most.
    slack = 0.0 if far else (p.shape[1] + 8) * np.finfo(kind).eps * 16 * np.sqrt(p2.max(initial=0))
    out, parts, bounds = [], _groups(place, GROUP), np.empty((0 if far else AHEAD, len(p)), kind)
    for turn, part in enumerate(parts):
        # The least that any query of the group can have with a point.
        if far:
            centre, radius = _ball(place[part])
            bound = np.maximum(np.sqrt(np.maximum(p2 - 2 * (p @ centre) + centre @ centre, 0)) - radius, 0)
        else:
            if turn % AHEAD == 0:
                balls = np.array([np.append(centre, -radius) for centre, radius in (_ball(place[x]) for x in parts[turn : turn + AHEAD])], kind)
                np.matmul(balls, right.T, out=bounds[: len(balls)])
            bound = bounds[turn % AHEAD]
        those, those_ids, their_left, their_own = q[part], q_ids[part], left[part], own[part]
        best_rows, best_at, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        last, last_id = np.full(len(part), np.inf), np.zeros(len(part), p_ids.dtype)
        first_ones = _least(bound, CHUNK)
        steps, seen = [first_ones] if len(bound) else [], None
        while steps:
            some = steps.pop()
            ordered = isinstance(some, np.ndarray)
            # The points come in the order of their bounds.
            if seen is not None and ordered and bound[some[0]] > _reached(last, margin, norms[part], far) + slack:
                break
            many = len(some) if ordered else some.stop - some.start
            near = np.matmul(their_left, right[some].T, out=room[: len(part) * many].reshape(len(part), many))
            k_th = last
            if seen is None and many > k + again:
                # The first chunk's own k-th values bound the candidates.
                k_th = np.partition(near, k + again - 1, axis=1)[:, k + again - 1].astype(np.float64) + their_own + margin
            # In the products' own precision, as a wider one would be compared far slower.
            most = (k_th + margin - their_own + np.finfo(kind).eps * 2 * scale).astype(kind)
            rows, at = np.divmod(_true_places(np.less_equal(near, most[:, None], out=flags[: near.size].reshape(near.shape)), flags), many)
            at = some[at] if ordered else at + some.start
            if not ordered:
                rows, at = rows[~seen[at]], at[~seen[at]]
            if not_itself:
                other = p_ids[at] != those_ids[rows]
                rows, at = rows[other], at[other]
            a, b = those[rows], p[at]
            value = np.round(((a - b) ** 2).sum(1) if far else -(a * b).sum(1), DIGITS) + 0.0
            hit = (value < last[rows]) | ((value == last[rows]) & (p_ids[at] < last_id[rows])) | ~np.isfinite(last[rows])
            if hit.any():
                best_rows, best_at, best = np.append(best_rows, rows[hit]), np.append(best_at, at[hit]), np.append(best, value[hit])
                first = _first_of(best_rows, best, p_ids[best_at], k)
                best_rows, best_at, best = best_rows[first], best_at[first], best[first]
                full = np.flatnonzero(np.bincount(best_rows, minlength=len(part)) == k)
                ends = np.searchsorted(best_rows, full, "right") - 1
                last[full], last_id[full] = best[ends], p_ids[best_at[ends]]
            if seen is None:
                # The others, if their bounds reach the k-th values.
                seen = bound <= _reached(last, margin, norms[part], far) + slack
                seen[first_ones] = False
                rest = np.flatnonzero(seen)
                if 2 * len(rest) > len(bound):
                    # Nearly all: in their own order, which spares sorting and moving them.
                    seen[:] = False
                    seen[first_ones] = True
                    steps = [slice(i, min(i + CHUNK, len(bound))) for i in range(0, len(bound), CHUNK)]
                else:
                    rest = rest[np.argsort(bound[rest])]
                    steps = [rest[i : i + CHUNK] for i in range(0, len(rest), CHUNK)][::-1]
        out.append((part[best_rows], kept[best_at], best))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _ball(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and radius of a ball around the vectors."""
    centre = vectors.mean(0)
    return centre, np.sqrt(((vectors - centre) ** 2).sum(1).max()) * (1 + 1e-9)


def _least(values: np.ndarray, many: int) -> np.ndarray:
    """Places of about ``many`` of the least values, by the ranks of some of them; never more."""
    if len(values) <= many:
        return np.arange(len(values))
    step = max(1, len(values) >> 14)
    some, n = values[::step], -(-many // step)
    return np.flatnonzero(values <= np.partition(some, n - 1)[n - 1])[:many]


def _true_places(found: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Places of what is true in an array that begins flags, eight at a time, as few are."""
    n = found.size
    flags[n : n + 8] = False
    words = np.flatnonzero(flags[: -(-n // 8) * 8].view(np.uint64))
    places = (words[:, None] * 8 + np.arange(8)).ravel()
    return places[flags[places]]


def _reached(last: np.ndarray, margin: float, norms: np.ndarray, far: bool) -> float:
    """The largest bound with which a point can still be among the best of a group."""
    if far:
        return float(np.sqrt(last.max() + margin) * (1 + 1e-9) + margin)
    return float(np.max((last + margin) / norms) if norms.min() > 0 else np.inf)


def _dealt(rows: DataFrame, side: int, blocks: int, other_blocks: int) -> DataFrame:
    """rows with the pair of blocks they belong to, once for each block of the other side."""
    own, other = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))
    pair = F.col("_own") * other_blocks + F.col("_other") if side == 0 else F.col("_other") * blocks + F.col("_own")
    return rows.select("id", "vector", own.alias("_own"), other.alias("_other")).select(pair.alias("pair"), F.lit(side).cast("tinyint").alias("side"), "id", "vector")


def _matrix(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors whose components are all finite numbers."""
    vectors = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in rows.column("vector").chunks] or [np.zeros(0)]).reshape(-1, width).astype(np.float64)
    whole = np.isfinite(vectors).all(1)
    ids = rows.column("id").to_numpy()
    return (ids, vectors) if whole.all() else (ids[whole], vectors[whole])


def best_pairs(queries: DataFrame, points: DataFrame, k: int, by: str = "product", not_itself: bool = False, block: int | None = None) -> DataFrame:
    """query, neighbor, value, rank of the k best points of each query; both sides with id and vector, ids of one type. by: "product" (the largest dot products) or "distance"
    (the smallest squared distances). Values are rounded to DIGITS digits; smaller ids first among equals. not_itself: leave a point out of the query of its own id.
    block: rows of a block on either side, by default as many as a task holds with ease.

    Rows without an id or a vector, with a vector of another length than most points', or with components that are no finite numbers, are left out.
    """
    # Single precision stays so on its way.
    vector = lambda rows: F.col("vector").cast("array<float>" if rows.schema["vector"].dataType == T.ArrayType(T.FloatType()) else "array<double>").alias("vector")
    whole = lambda rows: rows.select("id", vector(rows)).filter("id IS NOT NULL AND vector IS NOT NULL")
    schema = T.StructType([T.StructField("query", queries.schema["id"].dataType), T.StructField("neighbor", points.schema["id"].dataType), T.StructField("value", T.DoubleType())])
    # Both sides are read several times, and may cost much to make.
    same = queries is points
    points = stored(whole(points))
    queries = points if same else stored(whole(queries))
    lengths = points.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None or not lengths.d:
        return points.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))
    points, queries = (rows.filter(F.size("vector") == lengths.d) for rows in (points, queries))
    blocks = lambda n, rows: max(1, -(-n // rows))
    n, width = queries.count(), lengths.d
    n_points = blocks(lengths.n, block or max(BLOCK, POINTS // width))
    n_queries = blocks(n, block) if block else max(blocks(n, max(BLOCK, QUERIES // width)), min(blocks(SPREAD, n_points), blocks(n, BLOCK)))
    sign = -1.0 if by == "product" else 1.0

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [x for x in batches if x.num_rows]
        if not batches:
            return
        rows, batches = pa.Table.from_batches(batches), None
        kind, pairs = rows.schema.field("id").type, pc.unique(rows.column("pair")).to_pylist()
        for pair in pairs:
            # Rows go once they are matrices; as a rule a partition is one pair.
            own, rows = (rows, None) if len(pairs) == 1 else (rows.filter(pc.equal(rows.column("pair"), pair)), rows)
            sides = [own.filter(pc.equal(own.column("side"), side)) for side in (0, 1)]
            own = None
            if all(x.num_rows for x in sides):
                (p_ids, b), (q_ids, a) = (_matrix(sides.pop(), width) for _ in range(2))
                some, at, values = block_best(a, q_ids, b, p_ids, k, by, not_itself)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[some], kind), pa.array(p_ids[at], kind), pa.array(values * sign + 0.0)], ["query", "neighbor", "value"])

    # A partition for each pair, whose work is many times its bytes: hashed keys would share tasks, and small partitions be put together.
    both = _dealt(queries, 0, n_queries, n_points).unionByName(_dealt(points, 1, n_points, n_queries)).repartitionById(n_queries * n_points, F.col("pair"))
    kind = both.schema["id"].dataType
    some = both.mapInArrow(meet, T.StructType([T.StructField("query", kind), T.StructField("neighbor", kind), T.StructField("value", T.DoubleType())]))
    some = some.select(*(F.col(x.name).cast(x.dataType) for x in schema))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("value") * sign, "neighbor"))
    return some.withColumn("rank", rank).filter(F.col("rank") <= k)


def item_vectors(ratings: DataFrame, users: list[str], centred: bool = True) -> DataFrame:
    """id, vector: an item's scores in the order of users, 0 where it has none; centred, less the mean of those it has."""
    mean = ratings.groupBy("item_id").agg(F.avg("prediction").alias("_m"), *(F.max(F.when(F.col("user_id") == u, F.col("prediction"))).alias(f"_{k}") for k, u in enumerate(users)))
    one = lambda k: F.coalesce(F.col(f"_{k}") - (F.col("_m") if centred else 0.0), F.lit(0.0))
    return mean.select(F.col("item_id").alias("id"), F.array(*(one(k) for k in range(len(users)))).alias("vector"))


def cross_similarity(new: DataFrame, known: DataFrame, users: list[str], k: int, epsilon: float = 1e-9) -> DataFrame:
    """item_id, neighbor, similarity, rank: for each item of the new ratings the k known items with the largest product of centred scores."""
    pairs = best_pairs(item_vectors(new, users), item_vectors(known, users), k)
    return pairs.select(F.col("query").alias("item_id"), "neighbor", (F.col("value") + epsilon).alias("similarity"), "rank")


def _mean(x: Column, w: Column) -> Column:
    """The mean weighted by w; the plain mean where the weights sum to zero."""
    return F.coalesce(F.when(F.abs(F.sum(w)) > 1e-7, F.sum(w * x) / F.sum(w)), F.avg(x))


def transferred_factors(similar: DataFrame, factors: DataFrame, rank: int) -> DataFrame:
    """item_id, f: factors of new items as means of those of their similar known ones (item_id, f), weighted by similarity."""
    near = similar.join(factors.select(F.col("item_id").alias("neighbor"), "f"), "neighbor")
    return near.groupBy("item_id").agg(F.array(*(_mean(F.get("f", F.lit(i)), F.col("similarity")) for i in range(rank))).alias("f"))


def transferred_cells(similar: DataFrame, cells: DataFrame, column: str) -> DataFrame:
    """user_id, item_id, column: of each rater a cell of each new item, as the mean of its cells of the similar known items, weighted by similarity."""
    near = similar.join(cells.select("user_id", F.col("item_id").alias("neighbor"), F.col(column).alias("_x")), "neighbor")
    return near.groupBy("user_id", "item_id").agg(_mean(F.col("_x"), F.col("similarity")).alias(column))


def predicted_new_items(new: DataFrame, known: DataFrame, similar: DataFrame) -> DataFrame:
    """user_id, item_id, predicted: scores of new items from how a rater's scores of similar known items differ from these items' means, plus the new item's own
    mean; weighted by similarity over the sum of its magnitudes."""
    means = lambda r: r.groupBy("item_id").agg(F.avg("prediction").alias("_m"))
    apart = known.join(means(known), "item_id").select("user_id", F.col("item_id").alias("neighbor"), (F.col("prediction") - F.col("_m")).alias("_x"))
    w = F.col("similarity")
    moved = similar.join(apart, "neighbor").groupBy("user_id", "item_id").agg(F.coalesce(F.try_divide(F.sum(w * F.col("_x")), F.sum(F.abs(w))), F.lit(0.0)).alias("_d"))
    return moved.join(means(new), "item_id").select("user_id", "item_id", (F.col("_m") + F.col("_d")).alias("predicted"))
