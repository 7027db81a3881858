"""Drawn cells and rows: balanced classes, intervals of an order, weights, densities, and resamples that hold all classes.

Draws hash keys with a seed, so a task that runs again draws the same. No class, rater or order is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlake.operators.numbering import numbered, ranked
from raterlake.operators.sampling import bootstrap_with_rest, draw
from raterlake.operators.state import stored


def balanced_cells(cells: DataFrame, estimate: str = "vote", multiple: float = 10, minority: int = 1, seed: int = 7) -> DataFrame:
    """The cells whose estimate is right: all of the minority class, and of the other ``multiple`` times as many for each rater, drawn (all, if it has fewer)."""
    right = cells.filter(F.col(estimate) == F.col("label"))
    few = right.groupBy("user_id").agg(F.floor(F.count_if(F.col("label") == minority) * multiple).alias("_most"))
    rows = numbered(right.withColumn("_seed", F.lit(seed)), ["user_id", "label"], ["_seed", "item_id"], "_k")
    return rows.join(few, "user_id").filter((F.col("label") == minority) | (F.col("_k") < F.col("_most"))).select(*cells.columns)


def balanced_by_labels(cells: DataFrame, multiple: float = 2, minority: int = 1, seed: int = 7) -> DataFrame:
    """Adds times, for each rater: 1 for cells of the minority class, and of the other class ``multiple`` times as many draws. If the class has more cells,
    none is drawn twice; else they are drawn with replacement. Cells that aren't drawn go."""
    sizes = cells.groupBy("user_id").agg(F.floor(F.count_if(F.col("label") == minority) * multiple).alias("_most"), F.count_if(F.col("label") != minority).alias("_n"))
    one = cells.filter(F.col("label") == minority).withColumn("times", F.lit(1).cast("long"))
    rows = numbered(cells.filter(F.col("label") != minority).withColumn("_seed", F.lit(seed)), ["user_id"], ["_seed", "item_id"], "_k").join(sizes, "user_id")
    without = rows.filter((F.col("_n") > F.col("_most")) & (F.col("_k") < F.col("_most"))).select(*cells.columns, F.lit(1).cast("long").alias("times"))
    short = sizes.filter((F.col("_n") <= F.col("_most")) & (F.col("_n") > 0) & (F.col("_most") > 0))
    numbers = short.select("user_id", "_n", F.explode(F.sequence(F.lit(1).cast("long"), "_most")).alias("_draw"))
    drawn = numbers.withColumn("_k", F.floor(draw(seed, "user_id", "_draw") * F.col("_n"))).groupBy("user_id", "_k").agg(F.count("*").alias("times"))
    again = rows.join(drawn, ["user_id", "_k"]).select(*cells.columns, "times")
    return one.unionByName(without).unionByName(again)


def lifted_positives(ratings: DataFrame, threshold: float = 0.5, margin: float = 0.01, seed: int = 7) -> DataFrame:
    """Scores of items with label 1 replaced by uniform draws between the threshold (and a margin) and 1."""
    low = threshold + margin
    return ratings.withColumn("prediction", F.when(F.col("label") == 1, low + (1 - low) * draw(seed, "user_id", "item_id")).otherwise(F.col("prediction")))


def in_intervals(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Adds part, 0 to parts - 1: the order cut at the places floor(k n / parts)."""
    n = df.count()
    part = F.floor((F.col("_rank") * parts - 1) / F.lit(max(n, 1)))
    return ranked(df, [F.asc(c) for c in order], "_rank").withColumn("part", part.cast("int")).drop("_rank")


def interval_sample(df: DataFrame, order: list[str], parts: int, key: list[str], seed: int = 7) -> DataFrame:
    """One drawn row of each interval of the order, with its part."""
    cut = in_intervals(df, order, parts)
    return cut.groupBy("part").agg(F.min_by(F.struct(*df.columns), F.struct(draw(seed, *key), *key)).alias("_r")).select("part", "_r.*")


def weighted_draws(df: DataFrame, key: str, n: int, weight: str | None = None, seed: int = 7) -> DataFrame:
    """draw (0 to n - 1) and the row that it took, with replacement, in proportion to the weights. Rows without a positive weight are never drawn.

    Rows lie in ranges of their key's hash, each of which adds up its own weights; the driver gets a sum for each range. Each draw's place goes to its range, where
    the last row that begins before the place is taken.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.withColumn("_w", w).filter("_w > 0").withColumn("_h", F.xxhash64(key))
    rows = stored(rows.repartitionByRange("_h", key).withColumn("_part", F.spark_partition_id()))
    starts, total = [], 0.0
    for row in sorted(rows.groupBy("_part").agg(F.sum("_w").alias("w")).collect()):
        starts.append((row["_part"], total))
        total += row["w"]
    if not starts:
        return df.limit(0).select(F.lit(0).cast("long").alias("draw"), "*")
    parts, offsets = (F.array(*(F.lit(x) for x in column)) for column in zip(*starts, strict=True))
    number = lambda at: F.size(F.filter(offsets, lambda x: x <= at))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (draw(seed, "id") * total).alias("_at"))
    draws = draws.withColumn("_part", F.get(parts, number(F.col("_at")) - 1))
    before = Window.partitionBy("_part").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)
    first = F.element_at(F.map_from_arrays(parts, offsets), F.col("_part"))
    begins = rows.withColumn("_at", first + F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    both = begins.select("_part", "_at", F.struct(*df.columns).alias("_r"), F.lit(None).cast("long").alias("draw")).unionByName(draws, allowMissingColumns=True)
    upto = Window.partitionBy("_part").orderBy("_at", F.col("draw").asc_nulls_first())
    return both.withColumn("_r", F.last("_r", ignorenulls=True).over(upto)).filter("draw is not null").select("draw", "_r.*")


def density_draws(df: DataFrame, key: str, value: str, bandwidth: float, n: int, weight: str | None = None, seed: int = 7) -> DataFrame:
    """n draws from the Gaussian density of the values: a row in proportion to its weight, and its value moved by a normal number times the bandwidth."""
    normal = F.sqrt(-2 * F.ln(1 - draw(seed + 1, "draw"))) * F.cos(2 * F.pi() * draw(seed + 2, "draw"))
    return weighted_draws(df, key, n, weight, seed).withColumn(value, F.col(value) + bandwidth * normal)


def negative_sample(candidates: DataFrame, targets: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n drawn candidates that aren't targets (all, if there are fewer)."""
    rest = candidates.select(key).distinct().join(targets.select(key), key, "left_anti").withColumn("_draw", draw(seed, key))
    return ranked(rest, [F.asc("_draw"), F.asc(key)], "_rank").filter(F.col("_rank") <= n).select(key)


def complete_bootstrap(items: DataFrame, key: str = "item_id", label: str = "label", cycles: int = 20, seed: int = 7) -> DataFrame:
    """Adds repetition and times of the first of ``cycles`` resamples that holds all classes (the last one, if none does); rows that it lacks go."""
    reps = bootstrap_with_rest(items, key, cycles, seed).filter("times > 0")
    classes = items.agg(F.count_distinct(label).alias("_classes"))
    held = reps.groupBy("repetition").agg(F.count_distinct(label).alias("_held")).crossJoin(classes)
    first = held.agg(F.coalesce(F.min(F.when(F.col("_held") == F.col("_classes"), F.col("repetition"))), F.max("repetition")).alias("repetition"))
    return reps.join(first, "repetition").select(*items.columns, "repetition", "times")
