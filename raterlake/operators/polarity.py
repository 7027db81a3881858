"""Polarity of cells without labels: from how each rater's right and wrong scores lie, is a cell right or wrong if its item is positive, and if it is negative?

Cells have user_id, item_id, prediction and vote. What is known of raters comes from coloured cells (color 2 TP, 1 TN, -2 FP, -1 FN): means, medians and ranges, or
counts on a grid of scores, all aggregates that tasks add up in parts. A cell meets its rater's row only (with densities: that of its score's bin), and items' cells
are compared over the short axis of raters.

Each cell gets two answers: if_positive, 1 for a likely TP, -1 for a likely FN, 0 undecided; and if_negative, 1 for a likely TN, -1 for a likely FP.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.functions import scalar
from raterlake.operators.numbering import numbered
from raterlake.operators.state import stored

COLORS = {"tp": 2, "tn": 1, "fp": -2, "fn": -1}
POLICIES = ("mean", "median", "interval", "density")
#: Bins of scores in [0, 1].
BINS = 32


def color_statistics(colored: DataFrame) -> DataFrame:
    """user_id, and for each of tp, tn, fp, fn how many cells a rater has, their mean, median, lowest and highest score (null without any).

    Scores have few digits, so what a median needs is bounded by the number of distinct scores.
    """
    out = []
    for name, color in COLORS.items():
        p = F.when(F.col("color") == color, F.col("prediction"))
        out += [F.count(p).alias(f"n_{name}"), F.avg(p).alias(f"mean_{name}"), F.median(p).alias(f"median_{name}"), F.min(p).alias(f"low_{name}"), F.max(p).alias(f"high_{name}")]
    return colored.groupBy("user_id").agg(*out)


def bin_of(score: Column, bins: int = BINS) -> Column:
    return F.greatest(F.least(F.floor(score * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def densities(colored: DataFrame, bins: int = BINS) -> DataFrame:
    """user_id, bin, and for each of tp, tn, fp, fn its share of the rater's density in this bin: of n cells, k near the bin (weights 1, 2, 1 over
    neighbouring bins), n (k + 1) / (4 n + bins). All bins of a rater are there."""
    names = list(COLORS)
    counts = colored.groupBy("user_id", bin_of(F.col("prediction"), bins).alias("bin")).agg(*(F.count_if(F.col("color") == COLORS[c]).alias(c) for c in names))
    near = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in ((-1, 1), (0, 2), (1, 1))))).alias("near")
    spread = counts.select("user_id", "bin", *names, near).select("user_id", (F.col("bin") + F.col("near.o")).alias("bin"), *((F.col(c) * F.col("near.w")).alias(c) for c in names))
    spread = spread.groupBy("user_id", "bin").agg(*(F.sum(c).alias(f"k_{c}") for c in names))
    totals = counts.groupBy("user_id").agg(*(F.sum(c).alias(f"n_{c}") for c in names))
    every = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(spread, ["user_id", "bin"], "left")
    share = lambda c: F.col(f"n_{c}") * (F.coalesce(F.col(f"k_{c}"), F.lit(0)) + 1.0) / (4.0 * F.col(f"n_{c}") + bins)
    return every.select("user_id", "bin", *(share(c).alias(c) for c in names))


def _either(one: Column, other: Column) -> Column:
    """1 or -1 where only one of two holds; null counts as no."""
    a, b = F.coalesce(one, F.lit(False)), F.coalesce(other, F.lit(False))
    return F.when(a & ~b, 1).when(b & ~a, -1).otherwise(0)


def hypotheses(cells: DataFrame, colored: DataFrame, policy: str = "median") -> DataFrame:
    """cells with if_positive and if_negative, from the coloured cells by a policy. mean, median: right positives lie at their rater's statistic or over it, wrong
    negatives at theirs or under it, and so on. interval: over the lowest right positive, under the highest wrong negative. density: whichever has more density.
    Cells of raters without coloured cells are undecided."""
    v = F.col("prediction")
    if policy == "density":
        known = densities(colored)
        joined = cells.withColumn("bin", bin_of(v)).join(known, ["user_id", "bin"], "left")
        pos, neg = _either(F.col("tp") > F.col("fn"), F.col("fn") > F.col("tp")), _either(F.col("tn") > F.col("fp"), F.col("fp") > F.col("tn"))
        return joined.withColumns({"if_positive": pos, "if_negative": neg}).drop("bin", *COLORS)
    known = color_statistics(colored)
    above, below = {"mean": ("mean", "mean"), "median": ("median", "median"), "interval": ("low", "high")}[policy]
    joined = cells.join(known.select("user_id", *{f"{s}_{c}" for s in (above, below) for c in COLORS}), "user_id", "left")
    # Means differ in their last digits by the order of summation.
    at = lambda s, c: F.round(F.col(f"{s}_{c}"), 9)
    pos, neg = _either(v >= at(above, "tp"), v <= at(below, "fn")), _either(v <= at(below, "tn"), v >= at(above, "fp"))
    return joined.withColumns({"if_positive": pos, "if_negative": neg}).drop(*{f"{s}_{c}" for s in (above, below) for c in COLORS})


def vote_odds(voted: DataFrame, known: DataFrame) -> DataFrame:
    """item_id, log_odds of the label 1 given how many raters vote for it: binomial with the rates of positive votes among the cells of positive and of negative items
    in ``known`` (with label), and their prior."""
    y, x = F.col("label"), F.col("vote")
    safe = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-6)), F.lit(1e-6))
    rates = known.agg(safe(F.coalesce(F.avg(F.when(y == 1, x)), F.lit(0.5))).alias("p1"), safe(F.coalesce(F.avg(F.when(y == 0, x)), F.lit(0.5))).alias("p0"))
    items = known.groupBy("item_id").agg(F.max("label").alias("label"))
    prior = items.agg(safe(F.coalesce(F.avg("label"), F.lit(0.5))).alias("prior"))
    tallies = voted.groupBy("item_id").agg(F.sum("vote").alias("ones"), F.count("*").alias("n"))
    # One row beside each item.
    all_ = tallies.crossJoin(F.broadcast(rates)).crossJoin(F.broadcast(prior))
    odds = F.col("ones") * F.ln(F.col("p1") / F.col("p0")) + (F.col("n") - F.col("ones")) * F.ln((1 - F.col("p1")) / (1 - F.col("p0"))) + F.ln(F.col("prior") / (1 - F.col("prior")))
    return all_.select("item_id", F.round(odds, 9).alias("log_odds"))


def supported(answered: DataFrame, positive: DataFrame, k_upper: int = 3, k_lower: int = 3, k_min: int = 1) -> DataFrame:
    """answered cells with polarity: for each item, up to k_upper cells that are right (1) and up to k_lower that are wrong (-1) under the label its row in ``positive``
    (item_id, positive) gives, the others 0.

    Under the label 1 the right cells with the highest scores and the wrong ones with the lowest count, under 0 the reverse; smaller user_ids among equals. If an item
    has cells of one kind only, as many of the other (k_min at least) are taken from the far side of their median; if it has none of either or none lie there, its
    k_min outermost cells on each side. A cell taken for both counts as wrong.
    """
    cells = answered.join(positive.select("item_id", "positive"), "item_id")
    yes = F.col("positive") == 1
    cells = cells.withColumn("_m", F.when(yes, F.col("if_positive")).otherwise(F.col("if_negative")))
    # Turned about for the label 0, so that right cells are high.
    cells = cells.withColumn("_v", F.when(yes, F.col("prediction")).otherwise(-F.col("prediction")))
    item, same = Window.partitionBy("item_id"), Window.partitionBy("item_id", "_m")
    high, low = [F.desc("_v"), F.asc("user_id")], [F.asc("_v"), F.asc("user_id")]
    rank = lambda w, order: F.row_number().over(w.orderBy(*order))
    cells = cells.withColumn("_c", F.when((F.col("_m") == 1) & (rank(same, high) <= k_upper), 1).when((F.col("_m") == -1) & (rank(same, low) <= k_lower), -1).otherwise(0))
    number = lambda k: F.count_if(F.col("_c") == k).over(item)
    middle = lambda k: F.median(F.when(F.col("_c") == k, F.col("_v"))).over(item)
    cells = cells.withColumns({"_right": number(1), "_wrong": number(-1), "_mid_right": middle(1), "_mid_wrong": middle(-1), "_high": rank(item, high), "_low": rank(item, low)})
    # Cells beyond the median are the outermost ones, so ranks over all cells are ranks among them.
    add_right = (F.col("_right") == 0) & (F.col("_wrong") > 0) & (F.col("_v") > F.col("_mid_wrong")) & (F.col("_high") <= F.greatest(F.lit(k_min), F.col("_wrong")))
    add_wrong = (F.col("_wrong") == 0) & (F.col("_right") > 0) & (F.col("_v") < F.col("_mid_right")) & (F.col("_low") <= F.greatest(F.lit(k_min), F.col("_right")))
    cells = cells.withColumns({"_is_right": (F.col("_c") == 1) | add_right, "_is_wrong": (F.col("_c") == -1) | add_wrong})
    both = F.bool_or("_is_right").over(item) & F.bool_or("_is_wrong").over(item)
    outer = F.when(F.col("_low") <= k_min, -1).when(F.col("_high") <= k_min, 1).otherwise(0)
    found = F.when(F.col("_is_wrong"), -1).when(F.col("_is_right"), 1).otherwise(0)
    out = cells.withColumn("polarity", F.when(both, found).otherwise(outer))
    return out.drop("_m", "_v", "_c", "_right", "_wrong", "_mid_right", "_mid_wrong", "_high", "_low", "_is_right", "_is_wrong")


def by_votes(voted: DataFrame, known: DataFrame, policy: str = "median", **limits: int) -> DataFrame:
    """Polarity of voted cells under the label that their items' votes make likelier, from coloured cells ``known``."""
    positive = vote_odds(voted, known).select("item_id", (F.col("log_odds") >= 0).cast("int").alias("positive"))
    return supported(hypotheses(voted, known, policy), positive, **limits)


def by_scores(voted: DataFrame, known: DataFrame, scores: DataFrame, policy: str = "median", threshold: float = 0.5, **limits: int) -> DataFrame:
    """The same under labels from a model's scores of items (item_id, score), such as a stacker's probabilities."""
    positive = scores.select("item_id", (F.col("score") >= threshold).cast("int").alias("positive"))
    return supported(hypotheses(voted, known, policy), positive, **limits)


def settled_labels(voted: DataFrame, known: DataFrame, policy: str = "density", moves: int = 2, most: int = 50) -> tuple[DataFrame, int]:
    """item_id, label of voted cells' items, and after how many rounds no label moved (``most`` at the latest).

    Labels begin with the votes' odds. In each round the items' cells, coloured by their present labels, join the known ones; an item takes the label under
    which more of its cells look right than wrong by comparison, and keeps its own if both do alike, or if it has moved ``moves`` times (labels
    that depend on each other could change places for ever). Each round's labels are written out, so plans don't grow.
    """
    need = ["user_id", "prediction", "color"]
    voted, known = stored(voted.select("user_id", "item_id", "prediction", "vote")), stored(known.select(*need, "item_id", "vote", "label"))
    labels = stored(vote_odds(voted, known).select("item_id", (F.col("log_odds") >= 0).cast("int").alias("label"), F.lit(0).alias("moves")))
    for turn in range(1, most + 1):
        own = voted.join(labels, "item_id").withColumn("color", scalar.color(F.col("label"), F.col("vote")))
        answers = hypotheses(voted, known.select(*need).unionByName(own.select(*need)), policy)
        lean = answers.groupBy("item_id").agg(F.sum(F.col("if_positive") - F.col("if_negative")).alias("lean"))
        new = F.when(F.col("moves") >= moves, F.col("label")).when(F.col("lean") > 0, 1).when(F.col("lean") < 0, 0).otherwise(F.col("label"))
        moved = new != F.col("label")
        now = stored(labels.join(lean, "item_id").select("item_id", new.alias("label"), (F.col("moves") + moved.cast("int")).alias("moves"), moved.alias("moved")))
        labels = now.drop("moved")
        if not now.filter("moved").count():
            return labels.drop("moves"), turn
    return labels.drop("moves"), most


def synthetic_items(colored: DataFrame, n: int, label: int = 1, seed: int = 0) -> DataFrame:
    """item_id (-1, -2, ...), user_id, prediction, label, color of n new items with this label: each rater's cell is drawn, with replacement, from its own cells of
    the two colours that go with the label. Draws are hashes of item and rater, so a task that runs again gives the same."""
    fitting = [2, -1] if label == 1 else [1, -2]
    pool = numbered(colored.filter(F.col("color").isin(fitting)).select("user_id", "item_id", "prediction", "color"), ["user_id"], ["item_id", "prediction"], "k", "of")
    raters = pool.select("user_id", "of").distinct()
    wanted = raters.withColumn("new", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("k", F.pmod(F.xxhash64(F.lit(seed), "new", "user_id"), F.col("of")))
    drawn = wanted.select("user_id", "new", "k").join(pool.select("user_id", "k", "prediction", "color"), ["user_id", "k"])
    return drawn.select((-F.col("new")).cast("long").alias("item_id"), "user_id", "prediction", F.lit(label).alias("label"), "color")
