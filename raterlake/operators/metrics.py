"""Thresholds and quality metrics as cumulative windows over distinct scores.

Every function takes rows with ``prediction`` and ``label`` (0/1) and computes one result for each value of ``keys``. Scores are first
grouped, so a window holds one row for each distinct score of a key and not one for each rating.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.functions import scalar


#: Scores of a level are cumulated together, and levels after that, so no rater's scores are sorted in one task.
LEVELS = 256


def curve(scored: DataFrame, keys: list[str]) -> DataFrame:
    """For each distinct score as a threshold: its own n and p (positives), n_pred, tp, fp, and the totals n_pos, n_neg. Null scores are skipped."""
    each = scored.filter("prediction is not null").groupBy(*keys, _level("prediction"), F.col("prediction").alias("threshold")).agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    return _cumulated(each, keys)


def _level(score: str) -> Column:
    return F.floor(F.col(score) * LEVELS).alias("_level")


def _cumulated(each: DataFrame, keys: list[str]) -> DataFrame:
    """The curve of rows that hold, for each key, n and p of each distinct threshold, and its _level."""
    # Running sums in two steps: over the few levels of a key, then within each level.
    above, whole = Window.partitionBy(*keys).orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    levels = each.groupBy(*keys, "_level").agg(F.sum("n").alias("_n"), F.sum("p").alias("_p"))
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    levels = levels.select(*keys, "_level", before("_n").alias("_n_above"), before("_p").alias("_p_above"), F.sum("_p").over(whole).alias("n_pos"), (F.sum("_n").over(whole) - F.sum("_p").over(whole)).alias("n_neg"))
    down = Window.partitionBy(*keys, "_level").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    n_pred, tp = F.col("_n_above") + F.sum("n").over(down), F.col("_p_above") + F.sum("p").over(down)
    rows = each.join(levels, [*keys, "_level"]).withColumn("n_pred", n_pred).withColumn("tp", tp)
    return rows.select(*keys, "threshold", "n", "p", "n_pred", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), "n_pos", "n_neg")


def _best(points: DataFrame, keys: list[str], score: Column, name: str) -> DataFrame:
    """The point with the largest score of each key; the lowest threshold among equals; null scores are skipped."""
    scored = points.withColumn(name, F.round(score, 9)).filter(F.col(name).isNotNull())
    top = F.max(F.struct(F.col(name), (-F.col("threshold")).alias("_low"), F.col("n_pred"), F.col("tp"), F.col("n_pos"), F.col("n_neg"))).alias("_top")
    out = scored.groupBy(*keys).agg(top)
    return out.select(*keys, (-F.col("_top._low")).alias("threshold"), F.col(f"_top.{name}").alias(name), "_top.n_pred", "_top.tp", "_top.n_pos", "_top.n_neg")


def fmax(scored: DataFrame, keys: list[str], beta: float = 1.0) -> DataFrame:
    """The threshold with the largest F-beta: keys, threshold, fmax, precision, recall."""
    b = beta**2
    f = F.try_divide((1 + b) * F.col("tp"), F.col("n_pred") + b * F.col("n_pos")).cast("double")
    best = _best(curve(scored, keys), keys, f, "fmax")
    return best.select(*keys, "threshold", "fmax", (F.col("tp") / F.col("n_pred")).alias("precision"), F.try_divide(F.col("tp"), F.col("n_pos")).alias("recall"))


def _rates() -> tuple[Column, Column]:
    return F.try_divide(F.col("tp"), F.col("n_pos")), F.try_divide(F.col("fp"), F.col("n_neg"))


def balanced_threshold(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold with the largest balanced accuracy."""
    tpr, fpr = _rates()
    return _best(curve(scored, keys), keys, (tpr + 1 - fpr) / 2, "balanced_accuracy").select(*keys, "threshold", "balanced_accuracy")


def youden_threshold(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold with the largest true minus false positive rate."""
    tpr, fpr = _rates()
    return _best(curve(scored, keys), keys, tpr - fpr, "youden").select(*keys, "threshold", "youden")


def equal_rate_threshold(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold where sensitivity and specificity are the nearest."""
    tpr, fpr = _rates()
    return _best(curve(scored, keys), keys, -F.abs(tpr - (1 - fpr)), "closeness").select(*keys, "threshold", "closeness")


def prior_threshold(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th largest score, k being the number of positives; no row for a key without any."""
    points = curve(scored, keys).filter("n_pos > 0 and n_pred >= n_pos")
    return points.groupBy(*keys).agg(F.max("threshold").alias("threshold"))


def fpr_confusion(scored: DataFrame, keys: list[str], rate: float = 0.1) -> DataFrame:
    """Confusion counts at the highest threshold whose false positive rate reaches the rate."""
    _, fpr = _rates()
    points = curve(scored, keys).filter(fpr >= rate)
    top = points.groupBy(*keys).agg(F.max(F.struct("threshold", "tp", "fp", "n_pos", "n_neg")).alias("t"))
    return top.select(*keys, "t.threshold", "t.tp", "t.fp", (F.col("t.n_pos") - F.col("t.tp")).alias("fn"), (F.col("t.n_neg") - F.col("t.fp")).alias("tn"))


THRESHOLDS = {"fmax": fmax, "balanced": balanced_threshold, "auc": equal_rate_threshold, "youden": youden_threshold, "prior": prior_threshold}


def thresholds(scored: DataFrame, keys: list[str], policy: str = "fmax") -> DataFrame:
    """keys, p_th by one of THRESHOLDS."""
    return THRESHOLDS[policy](scored, keys).select(*keys, F.col("threshold").alias("p_th"))


def auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule over distinct scores; null with one class only."""
    return _areas(curve(scored, keys), keys)


def _areas(points: DataFrame, keys: list[str]) -> DataFrame:
    # Between a threshold and the one above lie the score's own rows.
    area = F.sum((F.col("n") - F.col("p")) * (2 * F.col("tp") - F.col("p")) / 2.0)
    return points.groupBy(*keys).agg(F.try_divide(area, F.max(F.col("n_pos") * F.col("n_neg"))).cast("double").alias("auc"))


def losses(scored: DataFrame, keys: list[str], epsilon: float = 1e-15) -> DataFrame:
    """Brier and log loss, the Brier skill against the base rate, and RMSE."""
    p = F.least(F.greatest("prediction", F.lit(epsilon)), F.lit(1 - epsilon))
    log_loss = -F.avg(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))
    brier = F.avg(F.pow(F.col("label") - F.col("prediction"), 2))
    rate = F.avg("label")
    out = scored.groupBy(*keys).agg(brier.alias("brier_loss"), log_loss.alias("log_loss"), rate.alias("_rate"))
    skill = 1 - F.try_divide(F.col("brier_loss"), F.col("_rate") * (1 - F.col("_rate")))
    return out.select(*keys, "brier_loss", "log_loss", skill.alias("brier_skill"), F.sqrt("brier_loss").alias("rmse"))


def confusion(voted: DataFrame, keys: list[str], positive: int = 1) -> DataFrame:
    """tp, tn, fp, fn of the columns label and vote for one class as the positive."""
    y, v = F.col("label") == positive, F.col("vote") == positive
    return voted.groupBy(*keys).agg(F.count_if(y & v).alias("tp"), F.count_if(~y & ~v).alias("tn"), F.count_if(~y & v).alias("fp"), F.count_if(y & ~v).alias("fn"))


def label_metrics(counts: DataFrame) -> DataFrame:
    """Adds all rates of a confusion table; null where a denominator is 0."""
    c = {k: F.col(k) for k in ("tp", "tn", "fp", "fn")}
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tpr, tnr = ratio(c["tp"], c["tp"] + c["fn"]), ratio(c["tn"], c["tn"] + c["fp"])
    ppv, npv = ratio(c["tp"], c["tp"] + c["fp"]), ratio(c["tn"], c["tn"] + c["fn"])
    every = c["tp"] + c["tn"] + c["fp"] + c["fn"]
    spread = F.sqrt((c["tp"] + c["fp"]).cast("double") * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"]))
    return counts.withColumns(
        {
            "accuracy": ratio(c["tp"] + c["tn"], every),
            "precision": ppv,
            "recall": tpr,
            "specificity": tnr,
            "npv": npv,
            "fpr": 1 - tnr,
            "fnr": 1 - tpr,
            "fdr": 1 - ppv,
            "f1": ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]),
            "f2": ratio(5 * c["tp"], 5 * c["tp"] + c["fp"] + 4 * c["fn"]),
            "balanced_accuracy": (tpr + tnr) / 2,
            "mcc": F.try_divide(c["tp"].cast("double") * c["tn"] - c["fp"].cast("double") * c["fn"], spread),
        }
    )


def grid(scored: DataFrame, keys: list[str], step: float = 0.05, steps: int = 20) -> DataFrame:
    """Confusion counts at so many equally spaced thresholds. A score falls into the last threshold it reaches, so scores are
    counted once, and thresholds are cumulative sums of at most ``steps`` rows for each key."""
    level = F.least(F.floor(F.col("prediction") / step + 1e-9), F.lit(steps - 1)).cast("int")
    counts = scored.groupBy(*keys, level.alias("level")).agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    frame = counts.select(*keys).distinct().crossJoin(counts.sparkSession.range(steps).select(F.col("id").cast("int").alias("level")))
    filled = frame.join(counts, [*keys, "level"], "left").na.fill(0, ["n", "p"])
    down = Window.partitionBy(*keys).orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    out = filled.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down) - F.col("tp"))
    out = out.withColumn("fn", F.sum("p").over(whole) - F.col("tp")).withColumn("tn", F.sum("n").over(whole) - F.col("tp") - F.col("fp") - F.col("fn"))
    return out.select(*keys, (F.col("level") * step).alias("threshold"), "tp", "tn", "fp", "fn")


def performance(scored: DataFrame, keys: list[str]) -> DataFrame:
    """auc, fmax and its threshold, the losses, and the label metrics at that threshold."""
    best = fmax(scored, keys).select(*keys, "threshold", "fmax")
    voted = scored.join(F.broadcast(best) if not keys else best, keys) if keys else scored.crossJoin(best)
    counts = label_metrics(confusion(voted.withColumn("vote", scalar.vote(F.col("prediction"), F.col("threshold"))), keys))
    out = counts
    for part in (best, auc(scored, keys), losses(scored, keys)):
        out = out.join(part, keys) if keys else out.crossJoin(part)
    return out


def best_f_by_class(scored: DataFrame, keys: list[str], steps: int = 20) -> DataFrame:
    """For each key and class (1 and 0) the grid threshold with the largest F1 and the one with the largest balanced accuracy (the
    lowest among equals): keys, class, f1, f1_threshold, balanced_accuracy, balanced_threshold."""
    g = grid(scored, keys, 1.0 / steps, steps)
    c = {k: F.col(k).cast("double") for k in ("tp", "tn", "fp", "fn")}
    one = F.try_divide(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"])
    zero = F.try_divide(2 * c["tn"], 2 * c["tn"] + c["fn"] + c["fp"])
    balanced = (F.try_divide(c["tp"], c["tp"] + c["fn"]) + F.try_divide(c["tn"], c["tn"] + c["fp"])) / 2
    both = g.select(*keys, "threshold", F.explode(F.array(F.struct(F.lit(1).alias("class"), one.alias("f1")), F.struct(F.lit(0).alias("class"), zero.alias("f1")))).alias("x"), balanced.alias("b"))
    rows = both.select(*keys, "threshold", "x.class", F.round(F.coalesce("x.f1", F.lit(0.0)), 9).alias("f1"), F.round("b", 9).alias("b"))
    low = -F.col("threshold")
    best = rows.groupBy(*keys, "class").agg(F.max(F.struct("f1", low.alias("t"))).alias("f"), F.max(F.struct("b", low.alias("t"))).alias("g"))
    return best.select(*keys, "class", "f.f1", (-F.col("f.t")).alias("f1_threshold"), F.col("g.b").alias("balanced_accuracy"), (-F.col("g.t")).alias("balanced_threshold"))


def equal_error_rate(scored: DataFrame, keys: list[str], steps: int = 1000) -> DataFrame:
    """The first of equally spaced thresholds at which fewer negatives pass than positives fail, and the mean of both rates there."""
    g = grid(scored, keys, 1.0 / steps, steps)
    fpr = F.try_divide(F.col("fp").cast("double"), F.col("fp") + F.col("tn"))
    fnr = F.try_divide(F.col("fn").cast("double"), F.col("fn") + F.col("tp"))
    rows = g.withColumn("eer", (fpr + fnr) / 2).filter(fpr < fnr)
    return rows.groupBy(*keys).agg(F.min("threshold").alias("eer_threshold"), F.min_by("eer", "threshold").alias("eer"))


def macro_auc(scored: DataFrame, target: str) -> DataFrame:
    """class, auc (of the score for this class against all others) and macro, their mean."""
    classes = scored.select(F.col(target).alias("class")).distinct()
    # Each row counts once for each class, of which there are few: per class, rows are its own against the totals of each score.
    total = scored.groupBy("prediction").agg(F.count("*").alias("_all"))
    own = scored.groupBy(F.col(target).alias("class"), "prediction").agg(F.count("*").alias("_own"))
    rows = total.crossJoin(F.broadcast(classes)).join(own, ["class", "prediction"], "left").na.fill(0, ["_own"])
    each = rows.select("class", _level("prediction"), F.col("prediction").alias("threshold"), F.col("_all").alias("n"), F.col("_own").alias("p"))
    out = _areas(_cumulated(each, ["class"]), ["class"])
    return out.withColumn("macro", F.avg("auc").over(Window.partitionBy()))


def anomaly_threshold(scored: DataFrame, steps: int = 1000) -> DataFrame:
    """One row: of steps thresholds between the least and the largest score the one below which calling rows positive gives the largest F1
    (the first among equals)."""
    bounds = scored.agg(F.min("prediction").alias("_lo"), F.max("prediction").alias("_hi"), F.sum("label").alias("_pos"))
    rows = scored.crossJoin(F.broadcast(bounds))
    # A row is below the k-th threshold from some k on, so rows are counted by that k.
    first = (F.floor((F.col("prediction") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / steps) + 1e-9) + 1).cast("long")
    counts = rows.groupBy(first.alias("k"), "_lo", "_hi", "_pos").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    up = Window.partitionBy("_lo", "_hi", "_pos").orderBy("k")
    rows = counts.withColumn("n", F.sum("n").over(up)).withColumn("p", F.sum("p").over(up)).filter(F.col("k") < steps)
    f1 = F.round(2.0 * F.col("p") / (F.col("n") + F.col("_pos")), 9)
    epsilon = F.col("_lo") + F.col("k") * (F.col("_hi") - F.col("_lo")) / steps
    return rows.withColumn("f1", f1).withColumn("epsilon", epsilon).agg(F.max("f1").alias("f1"), F.max_by("epsilon", F.struct("f1", -F.col("k"))).alias("epsilon"))
