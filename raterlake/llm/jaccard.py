"""Exact n-gram Jaccard join with count-vector R-trees, and the components of its links.

A document's set is its distinct five-word shingles (lower case A-Z). Shingles are hashed into groups; the counts per group
are a point, and the summed coordinate minima of two points bound the overlap of their sets from above. A set of n shingles
has a fine point of n / 4 to n / 2 groups, as with fewer the bound of long documents says nothing; summed to ``GROUPS`` groups, it is
the coarse point that the trees hold. Fine points of different lengths are compared at the shorter one's groups.

One R-tree over all points can't be split over machines so that few parts meet, as random points of like size lie alike. So the
finest coordinates route the points: in a fixed order of all shingles, rarest first, two sets with a Jaccard similarity of t share one of
their first n - ceil(t n) + 1 shingles (the prefix filter), and each such shared coordinate is a cell with an R-tree of
its own. The order comes from a count sketch of fixed size over all documents; any order gives the same links.

1. Documents with the same set are one node. 2. Each node of a cell is compared with the cell's hub only (its most shared node), so a group
of thousands of copies makes a star and not all pairs; links that verify give components. 3. In cells of three or more nodes
that still hold several components, R-trees find all pairs of nodes of different components whose bound allows a
link; they are verified as well. Pairs within one component are not needed: the components stay the same. Step 3 makes
the result exact: no link between different components is lost. Cells of over ``BLOCK`` nodes are searched by pairs of blocks.

Defined results: null, empty and word-free texts have the empty set, link with nothing and are their own component. Rows that
share a doc_id are judged one by one. Null ids link too, but never name a component unless all ids in it are null. Sets are compared by
64-bit hashes of shingles, and node names are 64-bit hashes of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlake.llm import text as words_of
from raterlake.llm.shared import bitmap, checkpoint, components, in_bitmap, sorted_groups

GROUPS = 256
SKETCH = 1 << 18
SLICES = 16
BLOCK = 2048
LEAF = 32
#: Bytes of text whose words are found at a time: they take many times as much, and both sides of pairs are at work together.
TEXT = 1 << 18
#: Bits of the filter of texts that candidates need; a fixed size, and with more texts only a weaker filter.
FILTER_BITS = 1 << 23


def _shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for a, b in words_of.blocks(column, TEXT):
        w = words_of.words(column.slice(a, b - a))
        for i in range(b - a):
            yield words_of.shingle_set(w.hash[w.of(i)], k)


def _count(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        column = words_of.plain(batch.column(0))
        for a, b in words_of.blocks(column, TEXT):
            w = words_of.words(column.slice(a, b - a))
            # Each shingle counts once a document, closely enough: repeats within one only move the order.
            counts += np.bincount((words_of.runs(w.hash, k) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    step = SKETCH // SLICES
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([counts[i * step : (i + 1) * step].tobytes() for i in range(SLICES)], pa.binary())], ["slice", "counts"])


def _add(key, rows):
    import pandas as pd

    total = np.sum([np.frombuffer(x, np.int64) for x in rows["counts"]], axis=0)
    return pd.DataFrame({"slice": [key[0]], "counts": [total.tobytes()]})


def shingle_order(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Of each sketch bucket the bit length of its count: SKETCH bytes, whatever the number of documents."""
    parts = docs.select(text).mapInArrow(lambda b: _count(b, k), "slice int, counts binary").groupBy("slice").applyInPandas(_add, "slice int, counts binary").collect()
    if not parts:
        return np.zeros(SKETCH, np.uint8)
    counts = np.concatenate([np.frombuffer(bytes(p["counts"]), np.int64) for p in sorted(parts, key=lambda p: p["slice"])])
    return np.ceil(np.log2(counts + 1)).astype(np.uint8)


def fine_point(s: np.ndarray) -> np.ndarray:
    """Counts per group, by the leading bits of the hashes; GROUPS groups at least."""
    bits = max(GROUPS, len(s) // 2).bit_length() - 1
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def packed(point: np.ndarray) -> bytes:
    """One byte for each count, or four if one doesn't fit; numbers() tells them apart by the first byte."""
    small = point.max() < 256
    return bytes([1 if small else 4]) + point.astype(np.uint8 if small else np.uint32).tobytes()


def numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if raw[0] == 1 else np.uint32, offset=1)


def fold(point: np.ndarray, groups: int) -> np.ndarray:
    return point.reshape(groups, -1).sum(1, dtype=np.int64)


def _sign(batches: Iterator[pa.RecordBatch], order: np.ndarray, id_col: str, text: str, k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = words_of.plain(batch.column(text))
        sizes, nodes, points, coarse, prefixes, ends = [], [], [], [], [], [0]
        for s in _shingle_sets(column, k):
            n = len(s)
            sizes.append(n)
            if n:
                seal = words_of.mix(np.array([s.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(words_of.mix(s)) + np.uint64(n)], np.uint64))
                nodes.append(int(seal.view(np.int64)[0]))
                point = fine_point(s)
                points.append(packed(point))
                coarse.append(packed(fold(point, GROUPS)))
                length = n - (percent * n + 99) // 100 + 1
                prefixes.append(s[np.lexsort((s, order[s % np.uint64(SKETCH)]))[:length]])
            else:
                nodes.append(None)
                points.append(None)
                coarse.append(None)
                prefixes.append(s)
            ends.append(ends[-1] + len(prefixes[-1]))
        flat = np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(id_col), batch.column("_text"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(points, pa.binary()), pa.array(coarse, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
            ["id", "text_key", "n", "node", "point", "coarse", "prefix"],
        )


def signatures(docs: DataFrame, id_col: str, text: str, k: int, percent: int) -> DataFrame:
    """id, text_key, n, node, point, coarse, prefix of each row."""
    order = docs.sparkSession.sparkContext.broadcast(shingle_order(docs, text, k))
    keyed = docs.select(id_col, text, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, text_key bigint, n bigint, node bigint, point binary, coarse binary, prefix array<bigint>"
    return keyed.mapInArrow(lambda b: _sign(b, order.value, id_col, text, k, percent), schema)


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that the bound of their points allows to link."""
    for batch in batches:
        n, m = batch.column("n").to_numpy(), batch.column("n2").to_numpy()
        overlap = np.zeros(batch.num_rows, np.int64)
        for k in range(batch.num_rows):
            p, q = (numbers(batch.column(c)[k].as_py()) for c in ("point", "point2"))
            groups = min(len(p), len(q))
            overlap[k] = np.minimum(fold(p, groups), fold(q, groups)).sum()
        yield batch.filter(pa.array(100 * overlap >= percent * (n + m - overlap))).select(["a", "b", "text_a", "text_b"])


def _verify(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = words_of.plain(batch.column("one")), words_of.plain(batch.column("two"))
        keep = []
        for at in range(0, batch.num_rows, 200):
            for s, t in zip(_shingle_sets(left.slice(at, 200), k), _shingle_sets(right.slice(at, 200), k), strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    one = nodes.select(F.col("node").alias("a"), "n", "point", F.col("text_key").alias("text_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("point").alias("point2"), F.col("text_key").alias("text_b"))
    fits = (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    near = checkpoint(pairs.join(one, "a").join(two, "b").filter(fits).mapInArrow(lambda b: _bounded(b, percent), "a bigint, b bigint, text_a bigint, text_b bigint"))
    # A bitmap of fixed size keeps texts that no pair needs out of the shuffle.
    needed = bitmap(near.select(F.explode(F.array("text_a", "text_b")).alias("key")), "key", FILTER_BITS)
    needed = docs.sparkSession.sparkContext.broadcast(needed)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(needed.value, batch.column(0).to_numpy(), FILTER_BITS)))

    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.xxhash64(body).alias("key"), body.alias("body")).mapInArrow(some, "key bigint, body string").dropDuplicates(["key"])
    # dropDuplicates would make each side shuffle all over again, so the few texts are cut off here.
    texts = checkpoint(texts)
    joined = near.join(texts.select(F.col("key").alias("text_a"), F.col("body").alias("one")), "text_a").join(texts.select(F.col("key").alias("text_b"), F.col("body").alias("two")), "text_b")
    return joined.select("a", "b", "one", "two").mapInArrow(lambda b: _verify(b, k, percent), "a bigint, b bigint")


class RTree:
    """Points packed into boxes of LEAF neighbours, and boxes into boxes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # Packed by size first and then by the largest differences between groups.
        spread = np.argsort(-points.var(0))[:2]
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]] // 4, np.log2(sizes + 1) // 0.1))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            top, low, high = self.levels[-1]
            cuts = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Numbers of the points whose bound allows a similarity of percent."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = (x[at] for x in self.levels[depth])
            overlap = np.minimum(top, point).sum(1)
            fits = (100 * overlap >= percent * (size + low - overlap)) & (100 * high >= percent * size) & (percent * low <= 100 * size)
            at = at[fits]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def _search_cells(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    found: list[np.ndarray] = []
    for group in sorted_groups(batches, ["cell", "i", "j"]):
        comp = group.column("comp").to_numpy()
        if (comp == comp[0]).all():
            continue
        node, n = group.column("node").to_numpy(), group.column("n").to_numpy()
        points = np.stack([numbers(x) for x in group.column("coarse").to_pylist()]).astype(np.int32)
        # Nodes of the largest component needn't ask: the others ask for them.
        values, counts = np.unique(comp, return_counts=True)
        tree = RTree(points, n)
        for k in np.flatnonzero(comp != values[counts.argmax()]).tolist():
            hit = tree.search(points[k], int(n[k]), percent)
            hit = node[hit[comp[hit] != comp[k]]]
            if len(hit):
                found.append(np.stack((np.minimum(hit, node[k]), np.maximum(hit, node[k]))))
        if sum(x.shape[1] for x in found) > 100_000:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate([*found, np.zeros((2, 0), np.int64)], 1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def _components(docs: DataFrame, id_col: str, text: str, k: int, percent: int) -> DataFrame:
    """id, n, text_key, root (null without shingles) of each row."""
    signed = checkpoint(signatures(docs, id_col, text, k, percent))
    nodes = checkpoint(signed.filter("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("point").alias("point"), F.min("coarse").alias("coarse"), F.min("text_key").alias("text_key")))
    cells = signed.filter("n > 0").select(F.explode("prefix").alias("cell"), "node")
    # Most cells hold one row. They go before nodes are compared, so that only their counts are shuffled twice.
    several = cells.groupBy("cell").agg(F.count("*").alias("rows")).filter("rows > 1").select("cell")
    shared = checkpoint(cells.join(several.hint("shuffle_hash"), "cell").distinct())
    # The hub is the node that shares the largest part of its set's cells: the least edited one of a group of near copies.
    parts = shared.groupBy("node").agg(F.count("*").alias("c")).join(nodes.select("node", "n"), "node").select("node", (F.col("c") / F.col("n")).alias("part"))
    hubs = shared.join(parts, "node").groupBy("cell").agg(F.max(F.struct("part", "node")).alias("h")).select("cell", F.col("h.node").alias("hub"))
    stars = shared.join(hubs.hint("shuffle_hash"), "cell").filter("node != hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    links = checkpoint(_verified(stars, nodes, docs, text, k, percent))
    comps = components(links).withColumnRenamed("root", "comp")
    # Cells of two nodes are done; of the others, those with several components go to the trees.
    placed = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_cells = placed.groupBy("cell").agg(F.count("*").alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("size > 2 and x != y").select("cell", "size")
    rows = placed.select("cell", "node", "comp").join(open_cells.hint("shuffle_hash"), "cell").join(nodes.select("node", "n", "coarse"), "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp", "n", "coarse")
    pairs = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(lambda b: _search_cells(b, percent), "a bigint, b bigint").distinct()
    more = _verified(pairs, nodes, docs, text, k, percent)
    roots = components(links.unionByName(more))
    return signed.select("id", "n", "text_key", "node").join(roots, "node", "left").select("id", "n", "text_key", F.coalesce("root", "node").alias("root"))


def link_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """For each row: id_col, n_shingles (long) and component_id, the smallest id reachable by links, its own included."""
    whole = _components(docs, id_col, text, k, percent)
    least = whole.filter("n > 0").groupBy("root").agg(F.min("id").alias("least"))
    out = whole.join(least, "root", "left").withColumn("component_id", F.coalesce("least", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Of each component the row with the smallest id (then the smallest hash of the text, then any of equal rows), and all rows
    without shingles; the columns of docs."""
    whole = _components(docs, id_col, text, k, percent)
    kept = whole.filter("n > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_key")).alias("x"))
    kept = kept.select(F.col("x.id").alias("_id"), F.col("x.text_key").alias("_key")).distinct()
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.withColumn("_row_key", key)
    empty = rows.filter(~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    first = rows.join(kept, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_row_key") == F.col("_key")), "left_semi")
    # Rows equal in id and text are copies of one document; one of them stays.
    first = first.dropDuplicates([id_col, "_row_key"])
    return first.unionByName(empty).select(*docs.columns)
