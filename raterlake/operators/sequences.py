"""Features of an item's raters in a row: what each score says by its rater's right and wrong scores nearby, and what the raters beside say.

All that is known of a rater is a grid of counts by colour (SLOTS slots over [0, 1]), which tasks add up in parts. Tails, moments and Kolmogorov-Smirnov distances are
sums and running sums over that grid, in whole numbers, so they don't depend on the order of rows; no rater's scores are ever sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.operators.polarity import COLORS, bin_of

#: Slots of the grid, and slots of a bin that share one neighbourhood.
SLOTS, WIDTH = 1024, 32
#: Bins on each side of a bin that its neighbourhood takes in.
REACH = 2
_KINDS = ("all", *COLORS)


def grid(colored: DataFrame) -> DataFrame:
    """user_id, slot, and how many cells of any colour and of each stand there."""
    slot = bin_of(F.col("prediction"), SLOTS).alias("slot")
    return colored.groupBy("user_id", slot).agg(F.count("*").alias("all"), *(F.count_if(F.col("color") == c).alias(n) for n, c in COLORS.items()))


def tails(counts: DataFrame) -> DataFrame:
    """user_id, slot, h_rank (the share of a rater's cells in lower slots), and for each colour tail_*, the share of its cells in this slot or higher ones (0 without
    any). Every slot of each rater has a row."""
    users = counts.select("user_id").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    each = users.join(counts, ["user_id", "slot"], "left").na.fill(0, list(_KINDS))
    up, whole = Window.partitionBy("user_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("user_id")
    lower = lambda c: F.try_divide(F.coalesce(F.sum(c).over(up), F.lit(0)).cast("double"), F.sum(c).over(whole))
    return each.select("user_id", "slot", lower("all").alias("h_rank"), *(F.coalesce(1.0 - lower(c), F.lit(0.0)).alias(f"tail_{c}") for c in COLORS))


def _moments(kind: str) -> dict[str, Column]:
    """Standard deviation (in scores), skew and excess kurtosis of one kind from sums of powers; null if all values are one."""
    n, s1, s2, s3, s4 = (F.col(f"{kind}_{k}").cast("double") for k in range(5))
    m = F.try_divide(s1, n)
    m2 = F.try_divide(s2, n) - m * m
    m2 = F.when(m2 > 1e-9, m2)
    m3 = F.try_divide(s3, n) - 3 * m * F.try_divide(s2, n) + 2 * m * m * m
    m4 = F.try_divide(s4, n) - 4 * m * F.try_divide(s3, n) + 6 * m * m * F.try_divide(s2, n) - 3 * m * m * m * m
    return {f"sd_{kind}": F.sqrt(m2) / SLOTS, f"skew_{kind}": m3 / (m2 * F.sqrt(m2)), f"kurtosis_{kind}": m4 / (m2 * m2) - 3}


def neighbourhoods(counts: DataFrame) -> DataFrame:
    """user_id, bin, and how each colour lies among all of the rater's cells in this bin and REACH bins on each side: ks_* (the largest difference of their
    distributions), and the ratios sd_*, skew_* and kurtosis_* (over that of all cells plus 1e-4); 0 where a colour has no cell, or no spread."""
    own = F.floor(F.col("slot") / WIDTH).cast("int")
    around = F.explode(F.sequence(F.greatest(own - REACH, F.lit(0)), F.least(own + REACH, F.lit(SLOTS // WIDTH - 1)))).alias("bin")
    near = counts.select("user_id", "slot", *_KINDS, around)
    x = (F.col("slot") - F.col("bin") * WIDTH - WIDTH // 2).cast("long")
    power = lambda k: F.lit(1) if k == 0 else x if k == 1 else x * power(k - 1)
    sums = near.groupBy("user_id", "bin").agg(*(F.sum(F.col(c) * power(k)).alias(f"{c}_{k}") for c in _KINDS for k in range(5)))
    up, whole = Window.partitionBy("user_id", "bin").orderBy("slot"), Window.partitionBy("user_id", "bin")
    below = lambda c: F.try_divide(F.sum(c).over(up).cast("double"), F.sum(c).over(whole))
    apart = near.select("user_id", "bin", *(F.abs(below("all") - below(c)).alias(c) for c in COLORS))
    ks = apart.groupBy("user_id", "bin").agg(*(F.max(c).alias(f"ks_{c}") for c in COLORS))
    shapes = sums.withColumns({k: v for c in _KINDS for k, v in _moments(c).items()}).join(ks, ["user_id", "bin"])
    ratio = lambda s, c: F.coalesce(F.col(f"{s}_{c}") / (F.coalesce(F.col(f"{s}_all"), F.lit(0.0)) + 1e-4), F.lit(0.0)).alias(f"{s}_{c}")
    return shapes.select("user_id", "bin", *(F.coalesce(F.col(f"ks_{c}"), F.lit(0.0)).alias(f"ks_{c}") for c in COLORS), *(ratio(s, c) for s in ("sd", "skew", "kurtosis") for c in COLORS))


def features(voted: DataFrame, colored: DataFrame, lags: tuple[int, ...] = (1, 2)) -> DataFrame:
    """user_id, item_id and the features of each voted cell, from coloured cells.

    value, vote; tail_tptn and tail_fpfn (differences of tails); ks_, sd_, skew_ and kurtosis_ tpfp and tnfn (differences between colours near the score); h_rank
    among the rater's scores, v_rank among the item's (equal ones share their mean rank; as a share of its raters); first (of the item's raters by user_id); and value,
    vote and whether tail_tptn is 0 or more of the raters before (_1, _2) and after (_m1, _m2), null beyond the ends. Raters without coloured cells get 0.
    """
    counts = grid(colored)
    slot = bin_of(F.col("prediction"), SLOTS)
    cells = voted.select("user_id", "item_id", F.col("prediction").alias("value"), "vote", slot.alias("slot"), F.floor(slot / WIDTH).cast("int").alias("bin"))
    cells = cells.join(tails(counts), ["user_id", "slot"], "left").join(neighbourhoods(counts), ["user_id", "bin"], "left")
    gap = lambda s, a, b: F.coalesce(F.col(f"{s}_{a}") - F.col(f"{s}_{b}"), F.lit(0.0)).alias(f"{s}_{a}{b}")
    near = [gap(s, a, b) for s in ("ks", "sd", "skew", "kurtosis") for a, b in (("tp", "fp"), ("tn", "fn"))]
    item = Window.partitionBy("item_id")
    low, ties = F.rank().over(item.orderBy("value")), F.count("*").over(Window.partitionBy("item_id", "value"))
    out = cells.select("user_id", "item_id", "value", "vote", gap("tail", "tp", "tn"), gap("tail", "fp", "fn"), *near, F.coalesce("h_rank", F.lit(0.0)).alias("h_rank"), ((low + (ties - 1) / 2.0) / F.count("*").over(item)).alias("v_rank"))
    row = item.orderBy("user_id")
    out = out.withColumn("_leans", (F.col("tail_tptn") >= 0).cast("int")).withColumn("first", (F.row_number().over(row) == 1).cast("int"))
    beside = {f"{name}_{'m' if k < 0 else ''}{abs(k)}": F.lag(c, k).over(row) for k in (*lags, *(-k for k in lags)) for name, c in (("value", "value"), ("vote", "vote"), ("leans", "_leans"))}
    return out.withColumns(beside).drop("_leans")
