"""Vectors as short codes: one codebook for each part of the vector, trained by rounds of Lloyd's algorithm that only pass on what changed.

A vector's components become integers floor(scale x) and are cut into equal parts; each part is replaced by the index of the nearest entry (squared
Euclidean distance, the lower index among equals) of that part's codebook, which begins with the vectors of the smallest ids.

A round assigns every part and writes the assignments beside the vectors. For each entry, integer sums and counts of its parts are kept as a table of
running sums. A task compares the new assignments with those of the round before and gives only the difference, a minus for the entry left and a plus for the
entry joined, added up over the task: at most parts x entries x (width + 1) rows each, whatever it reads, and none once nothing moves. These
rows stand in the same table as the assignments, so a task that is run again replaces both. The driver holds the codebooks, whose size is given by
parameters. Integers make sums exact and independent of their order.

Defined results: rows are dropped whose vector is null, empty, holds a null, NaN or infinite component or one of 2^20 or more in magnitude (which
would overflow the sums), or has another length than most (of the lengths that divide into parts; the longer among equals). Null ids come
last in the order of ids; equal ids are ordered by their vectors. Null labels count as one label. With fewer vectors than entries a codebook has
as many entries as there are vectors. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterlake.llm.shared import dealt, stored

#: Components of this magnitude and more are out of range.
RANGE = 1 << 20
#: Rows compared with a codebook at a time.
ROWS = 4096


@dataclass
class Codebooks:
    """entries: parts x entries x width integers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, and its squared distance. vectors: rows x width, book: entries x width, integers."""
    if max(np.abs(vectors).max(initial=0), np.abs(book).max(initial=0)) < 1 << 22:
        # All products and sums stay below 2^53, so doubles are exact.
        x, c = vectors.astype(np.float64), book.astype(np.float64)
        d = (c * c).sum(1) - 2 * (x @ c.T)
        k = d.argmin(1)
        return k, (d[np.arange(len(k)), k] + (x * x).sum(1)).astype(np.int64)
    d = np.zeros((len(vectors), len(book)), np.int64)
    for j in range(book.shape[1]):
        d += (vectors[:, j, None] - book[None, :, j]) ** 2
    k = d.argmin(1)
    return k, d[np.arange(len(k)), k]


def _assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and the distance of each row."""
    codes, error = np.empty(vectors.shape[:2], np.uint16), np.zeros(len(vectors), np.int64)
    for a in range(0, len(vectors), ROWS):
        for p, book in enumerate(books):
            codes[a : a + ROWS, p], d = _nearest(vectors[a : a + ROWS, p], book)
            error[a : a + ROWS] += d
    return codes, error


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), parts, -1)


def _round(batches: Iterator[pa.RecordBatch], books: np.ndarray, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with their new codes, then the changes of the sums of this task."""
    parts, entries, width = books.shape
    change = np.zeros((parts, entries, width + 1), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = _matrix(batch.column("_v"), parts)
        new, _ = _assign(vectors, books)
        if "_codes" in batch.schema.names:
            old = np.stack([np.frombuffer(x, np.uint16) for x in batch.column("_codes").to_pylist()])
            moved = old != new
        else:
            old, moved = None, np.ones(new.shape, bool)
        for p in range(parts):
            some = np.flatnonzero(moved[:, p])
            gone = np.column_stack([np.ones(len(some), np.int64), vectors[some, p]])
            np.add.at(change[p], new[some, p], gone)
            if old is not None:
                np.subtract.at(change[p], old[some, p], gone)
        names = [*keep, "_v"]
        none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]
        codes = pa.array([row.tobytes() for row in new], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), codes, *none], [*names, "_codes", "part", "entry", "place", "change"])
    part, entry, place = np.nonzero(change)
    if len(part):
        fields = [batch.schema.field(c) for c in (*keep, "_v")]
        none = [pa.nulls(len(part), f.type) for f in fields] + [pa.nulls(len(part), pa.binary())]
        made = [pa.array(x, pa.int32()) for x in (part, entry, place)] + [pa.array(change[part, entry, place])]
        yield pa.RecordBatch.from_arrays([*none, *made], [*(f.name for f in fields), "_codes", "part", "entry", "place", "change"])


def _final(batches: Iterator[pa.RecordBatch], books: np.ndarray, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, error = _assign(_matrix(batch.column("_v"), len(books)), books)
        text = pa.array(["".join(f"{k:02x}" for k in row) for row in codes.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), text, pa.array(error)], [*keep, "code", "error"])


def integers(vectors: DataFrame, vector: str, parts: int, scale: float) -> DataFrame | None:
    """vectors with _v, the components floor(scale x) of the rows that count; None if there are none."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < RANGE))
    good = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & fits)
    common = good.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return None
    return good.filter(F.size(vector) == common.d).withColumn("_v", F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def _updated(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Each entry the floor of its parts' mean; entries without parts stay."""
    total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    for row in sums.collect():
        total[row.part, row.entry, row.place] = row.total
    n = total[:, :, :1]
    return np.where(n > 0, total[:, :, 1:] // np.maximum(n, 1), books)


def train(vectors: DataFrame, keep: list[str], id_column: str, parts: int, entries: int, rounds: int) -> tuple[Codebooks, DataFrame]:
    """Codebooks of rows with _v after so many rounds, and the rows in keep with _v as the last round wrote them."""
    first = vectors.select(id_column, "_v").orderBy(F.asc_nulls_last(id_column), "_v").limit(entries).collect()
    books = np.array([r["_v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    state = vectors.select(*keep, "_v")
    fields = [state.schema[c] for c in (*keep, "_v")] + [T.StructField("_codes", T.BinaryType())]
    schema = T.StructType(fields + [T.StructField(c, T.IntegerType()) for c in ("part", "entry", "place")] + [T.StructField("change", T.LongType())])
    sums = None
    for _ in range(rounds):
        written = stored(state.mapInArrow(lambda batches, now=books: _round(batches, now, keep), schema))
        changes = written.filter("part IS NOT NULL").select("part", "entry", "place", F.col("change").alias("total"))
        moved = changes if sums is None else sums.unionByName(changes)
        sums = stored(moved.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")))
        books = _updated(books, sums)
        state = written.filter("part IS NULL").select(*keep, "_v", "_codes")
    return Codebooks(books), state.select(*keep, "_v")


def _same(column: Column) -> Column:
    """A key that nulls share."""
    return F.struct(column.isNull().alias("none"), column.alias("value")).cast("string")


def encode_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all but the vector by default) of each row that counts, with code (two hex digits for each part), error (squared distance to
    the code's entries), label_error (the errors of all rows of the same label) and codebooks_sha256 (of all entries, by part, entry and place)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part, so a codebook holds 1 to 256 entries")
    made = {"code", "error", "label_error", "codebooks_sha256", "_v", "_codes", "_key", "_salt", "part", "entry", "place", "change"}
    keep = [c for c in (keep if keep is not None else vectors.columns) if c not in made and c != vector]
    keep = list(dict.fromkeys([id_column, label, *keep]))
    fields = [vectors.schema[c] for c in keep] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    ready = integers(vectors.select(*keep, vector), vector, parts, scale)
    if ready is None:
        whole = T.StructType([*fields, T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
        return vectors.sparkSession.createDataFrame([], whole)
    books, rows = train(ready, keep, id_column, parts, entries, rounds)
    coded = stored(rows.mapInArrow(lambda batches: _final(batches, books.entries, keep), T.StructType(fields)).withColumn("_key", _same(F.col(label))))
    totals = coded.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    by_label, totals = dealt(coded, totals, ["_key"], "_n", F.xxhash64(id_column, "code"))
    out = by_label.join(totals.drop("_n"), ["_key", "_salt"])
    return out.select(*keep, "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
