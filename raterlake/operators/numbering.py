"""Numbers of rows within a key, where a key may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.operators.state import stored


def numbered(rows: DataFrame, keys: list[str], by: list[str], name: str = "number", total: str | None = None, parts: int = 64) -> DataFrame:
    """rows with a number 0, 1, 2, ... within their keys, and total, the key's number of rows, if it is named.

    Rows are dealt over ``parts`` by a hash of ``by`` (which should tell a key's rows apart), numbered in each part, and moved by the sizes of the parts before, so
    no task sorts more than a part of a key. The order is that of the hash's part, then of ``by``: the same in every run.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(parts)))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        sizes = sizes.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*by)) - 1
    # Rows whose key is null are numbered together.
    sizes = sizes.drop("_n").withColumnsRenamed({k: f"_of_{k}" for k in (*keys, "_part")})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, "_part")]
    out = dealt.withColumn("_place", place).join(sizes, same)
    return out.withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before", *(f"_of_{k}" for k in (*keys, "_part")))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place 1, 2, ... in an order over all of them. They are dealt over ranges, sorted there and written out; the sizes of the ranges before are
    the only thing that is brought together."""
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # monotonically_increasing_id is the partition's number, shifted by 33 bits, plus the row's place in it.
    part, before, sizes = F.shiftright("_at", 33).cast("int"), 0, []
    for row in sorted(ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        sizes.append((row.part, before))
        before += row.n
    offsets = rows.sparkSession.createDataFrame(sizes, "_part int, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, rank).drop("_at", "_part", "_before")
