"""Undersampling of the larger class by neighbours: what lies close to the smaller class, and what disagrees with its surroundings.

Points have id, vector and label. All neighbours come from best pairs of blocks, so classes of any size meet without a row for each pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlake.operators.numbering import ranked
from raterlake.operators.topk import best_pairs


def near_miss(points: DataFrame, minority, candidates: int = 3, k: int = 3) -> DataFrame:
    """The points of the minority, and as many others: of those that are among the ``candidates`` nearest others of a minority point, the ones with the largest mean
    distance to their k nearest minority points (smaller ids among equals). Fewer if there are fewer candidates."""
    few, many = points.filter(F.col("label") == minority), points.filter(F.col("label") != minority)
    close = best_pairs(few, many, candidates, "distance").select(F.col("neighbor").alias("id")).distinct()
    apart = best_pairs(many.join(close, "id", "left_semi"), few, k, "distance")
    means = apart.groupBy(F.col("query").alias("id")).agg(F.round(F.avg(F.sqrt("value")), 6).alias("_d"))
    chosen = ranked(means, [F.desc("_d"), F.asc("id")], "_rank").filter(F.col("_rank") <= few.count()).select("id")
    return few.unionByName(many.join(chosen, "id", "left_semi"))


def cleaned(points: DataFrame, minority, k: int = 3) -> DataFrame:
    """points without the others that disagree with their surroundings: those whose k nearest points are mostly minority, and those among the k nearest of a
    minority point whose k nearest are mostly others. A tie counts for the point itself."""
    own = points.select("id", (F.col("label") == minority).alias("few"))
    near = best_pairs(points, points, k, "distance", not_itself=True).select(F.col("query").alias("id"), "neighbor")
    pairs = near.join(own, "id").join(own.select(F.col("id").alias("neighbor"), F.col("few").alias("_few")), "neighbor")
    against = pairs.groupBy("id", "few").agg((F.count_if(F.col("few") != F.col("_few")) * 2 > F.count("*")).alias("outvoted")).filter("outvoted")
    noisy = against.filter("NOT few").select("id")
    beside = pairs.join(against.filter("few").select("id"), "id", "left_semi").filter("NOT _few").select(F.col("neighbor").alias("id"))
    return points.join(noisy.union(beside).distinct(), "id", "left_anti")
