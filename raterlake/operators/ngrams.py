"""Tokens and n-gram counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.functions import arrays


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters, digits and ``-_:.``."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([-0-9a-z_:.]+)"), F.lit(1))


def counts(rows: DataFrame, tokens: str, lengths: list[int], ordered: bool = True) -> DataFrame:
    """n, ngram, count within each row; without order, n-grams of the same tokens are one."""
    out = None
    for n in lengths:
        grams = arrays.windows(F.col(tokens), n)
        grams = grams if ordered else F.transform(grams, lambda x: F.sort_array(x))
        one = rows.select(F.lit(n).alias("n"), F.explode(F.transform(grams, lambda x: F.array_join(x, " "))).alias("ngram"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("n", "ngram").agg(F.count("*").alias("count"))


def most_frequent(table: DataFrame, num: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("count"), "ngram"))
    return table.withColumn("rank", rank).filter(F.col("rank") <= num)


def counts_of(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Counts of the wanted n-grams (n, ngram), 0 for those that don't occur."""
    return wanted.join(table, ["n", "ngram"], "left").na.fill(0, ["count"])


def across_lines(lines: DataFrame, order: list[str], tokens: str, n: int) -> DataFrame:
    """Counts of n-grams over the tokens of all lines in their order within each document (the first of order)."""
    doc = order[0]
    flat = lines.groupBy(doc).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order[1:], tokens))), lambda x: x[tokens])).alias("_t"))
    return counts(flat, "_t", [n])
