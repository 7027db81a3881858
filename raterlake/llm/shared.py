"""Cutting lineage in shared storage, connected components, and groups of sorted rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: No key of a dealt join keeps more than one of so many parts of the rows in one place.
PARTS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local folder only where none is set and everything runs on this machine, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def dealt(rows: DataFrame, counts: DataFrame, keys: list[str], n: str, by: Column) -> tuple[DataFrame, DataFrame]:
    """rows and counts (one row for each of the keys, with n rows' number) with a column _salt more, to be joined by keys and _salt.

    Rows of a key that holds over 1 / PARTS of all are dealt by ``by`` (a number that the row itself gives, as tasks may run
    again) over so many salts that none holds more. There are at most PARTS such keys, which are broadcast, and at most as many more
    rows in counts. Keys that are null don't meet.
    """
    limit = (counts.agg(F.sum(n)).first()[0] or 0) // PARTS + 1
    more = F.when(F.col(n) > limit, F.floor(F.col(n) / limit)).otherwise(0).cast("long")
    heavy = counts.filter(F.col(n) > limit).select(*keys, (more + 1).alias("_salts"))
    rows = rows.join(F.broadcast(heavy), keys, "left")
    rows = rows.withColumn("_salt", F.coalesce(F.pmod(by, F.col("_salts")), F.lit(0)).cast("long")).drop("_salts")
    return rows, counts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), more)))


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as a table and read again: smaller than a checkpoint, and read by columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    # The shuffle files behind it are deleted once the driver's JVM has collected what names them.
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Deletes what stored() wrote for these tables, once nothing will read them again."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
            if not folder.rsplit("/", 1)[-1].startswith("table-"):
                raise ValueError(f"{folder} was not written by stored()")
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bytes of a bitmap with the bit pmod(column, bits) of each value set. Its size is the caller's, whatever the rows; a full one tells less."""
    place = F.pmod(F.col(column), F.lit(bits)) + 1
    parts = df.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(-(-bits // 32768) * 4096, np.uint8)
    for part in parts:
        out[(part["k"] - 1) * 4096 : part["k"] * 4096] = np.frombuffer(bytes(part["bits"]), np.uint8)
    return out


def in_bitmap(bitmap_: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bit of each value (int64; bits: a power of 2) is set."""
    place = values & (bits - 1)
    return bitmap_[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node connected with each node of the edges (long, without nulls).

    Large-star and small-star steps by turns (Kiveris et al., Connected components in MapReduce and beyond) until nothing
    changes: about log^2 of the longest path many, and each keeps at most as many edges as there were. A node of many edges is
    reduced to a minimum by a partial aggregate.
    """
    edges = checkpoint(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpoint(small.select("e.*").filter("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of one or many groups of rows with equal keys (without nulls), none of which is cut, of batches that come sorted by keys."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        same = np.logical_and.reduce([v == v[-1] for v in values])
        cut = batch.num_rows - int(same[::-1].argmin() or batch.num_rows) if not same.all() else 0
        if cut or (rest and any(rest[-1].column(k)[-1].as_py() != v[-1] for k, v in zip(keys, values, strict=True))):
            if parts := [*rest, *([batch.slice(0, cut)] if cut else [])]:
                yield pa.Table.from_batches(parts)
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys (without nulls), of batches that come sorted by keys."""
    rest: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        first = [table.column(k)[0].as_py() for k in keys]
        if rest and first != [rest[-1].column(k)[-1].as_py() for k in keys]:
            yield pa.concat_tables(rest)
            rest = []
        values = [table.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1
        bounds = [0, *cuts.tolist(), table.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            part = table.slice(a, b - a)
            if b < table.num_rows:
                yield pa.concat_tables([*rest, part])
                rest = []
            else:
                rest.append(part)
    if rest:
        yield pa.concat_tables(rest)
