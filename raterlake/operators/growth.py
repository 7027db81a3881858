"""Ensembles grown from their first members to the full size, for all folds at once.

A model is what is chosen on all folds but one. Each step adds a member to every model: its plan reads the rows of all models' candidates in one pass, so
the number of jobs is that of the steps. How alike raters are comes from sums for each fold and pair of raters, taken once; those of a model are the total less
its own fold's. The sums of the members' scores are state, written out after each step. The driver gets one name for each model and step.

Items that a candidate has no score of take no part in its own score; a mean is that of the members that have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlake.operators import metrics
from raterlake.operators.sampling import draw
from raterlake.operators.state import stored

POLICIES = ("greedy", "forward", "enhanced", "drep", "sdi")


def held_out(ratings: DataFrame) -> DataFrame:
    """The rows of each model: those of all folds but the model's."""
    models = ratings.select(F.col("fold").alias("model")).distinct()
    return ratings.join(models, F.col("fold") != F.col("model")).select("model", "user_id", "item_id", "prediction", "label")


def likeness(ratings: DataFrame) -> DataFrame:
    """model, a, b, rho: the absolute correlation of two different raters' scores on the model's folds, to six digits; 0 where one is constant."""
    own = ratings.select("fold", "item_id", F.col("user_id").alias("a"), F.col("prediction").alias("x"))
    other = ratings.select("fold", "item_id", F.col("user_id").alias("b"), F.col("prediction").alias("y"))
    x, y = F.col("x"), F.col("y")
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    terms = (F.lit(1.0), x, y, x * x, y * y, x * y)
    sums = own.join(other, ["fold", "item_id"]).filter("a < b").groupBy("fold", "a", "b").agg(*(F.sum(t).alias(n) for t, n in zip(terms, names, strict=True)))
    # A pair without items in a fold has no row there, but belongs to that fold's model as well.
    total = sums.groupBy("a", "b").agg(*(F.sum(n).alias(f"all_{n}") for n in names))
    models = ratings.select(F.col("fold").alias("model")).distinct()
    less = sums.withColumnRenamed("fold", "model")
    rest = models.crossJoin(total).join(less, ["model", "a", "b"], "left")
    rest = rest.select("model", "a", "b", *((F.col(f"all_{n}") - F.coalesce(n, F.lit(0.0))).alias(n) for n in names)).filter("n > 0")
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in names)
    # Sums of squares that differ from those of a constant by rounding only count as such.
    spread = lambda s, ss: F.when(n * ss - s * s > 1e-9 * n * ss, n * ss - s * s)
    rho = F.abs(F.try_divide(n * sxy - sx * sy, F.sqrt(spread(sx, sxx)) * F.sqrt(spread(sy, syy))))
    half = rest.select("model", "a", "b", F.round(F.least(F.coalesce(rho, F.lit(0.0)), F.lit(1.0)), 6).alias("rho"))
    return half.unionByName(half.select("model", F.col("b").alias("a"), F.col("a").alias("b"), "rho"))


def _score(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    out = metrics.fmax(rows, keys) if metric == "fmax" else metrics.auc(rows, keys)
    return out.select(*keys, F.round(metric, 6).alias("score"))


def _candidates(own: DataFrame, members: DataFrame, alike: DataFrame) -> DataFrame:
    """model, user_id, score (its own), diversity: the mean likeness of all pairs of the ensemble with the candidate."""
    inside = members.select("model", F.col("user_id").alias("a"))
    within = alike.join(inside, ["model", "a"]).join(members.select("model", F.col("user_id").alias("b")), ["model", "b"])
    within = within.groupBy("model").agg((F.sum("rho") / 2).alias("_within"))
    size = members.groupBy("model").agg(F.count("*").alias("_k"))
    toward = alike.join(inside, ["model", "a"]).groupBy("model", F.col("b").alias("user_id")).agg(F.sum("rho").alias("_toward"))
    rest = own.join(members.select("model", "user_id"), ["model", "user_id"], "left_anti").join(size, "model")
    rest = rest.join(within, "model", "left").join(toward, ["model", "user_id"], "left")
    pairs = F.col("_k") * (F.col("_k") + 1) / 2
    mean = F.round((F.coalesce("_within", F.lit(0.0)) + F.coalesce("_toward", F.lit(0.0))) / pairs, 9)
    return rest.select("model", "user_id", "score", mean.alias("diversity"))


def _first(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The n first candidates of each model; there are as many rows as raters."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy("model").orderBy(*order, "user_id"))).filter(F.col("_place") <= n).drop("_place")


def _next(policy: str, candidates: DataFrame, train: DataFrame, sums: DataFrame, metric: str, most: int, least: int, weight: float, seed: int) -> DataFrame:
    """model, user_id of the next member by a policy."""
    drawn = candidates if policy in ("greedy", "forward") else _first(candidates, [draw(seed, "model", "user_id")], most)
    if policy == "greedy":
        return _first(drawn, [F.desc("score")], 1)
    if policy == "sdi":
        return _first(drawn, [F.desc(F.round(weight * F.col("score") + (1 - weight) * (1 - F.col("diversity")), 9))], 1)
    drawn = _first(drawn, ["diversity"], least) if policy == "drep" else drawn
    rows = train.join(drawn.select("model", "user_id"), ["model", "user_id"]).join(sums, ["model", "item_id"], "left")
    mean = (F.coalesce("_sum", F.lit(0.0)) + F.col("prediction")) / (F.coalesce("_n", F.lit(0)) + 1)
    return _first(_score(rows.withColumn("prediction", F.round(mean, 9)), ["model", "user_id"], metric), [F.desc("score")], 1)


def grown(
    ratings: DataFrame, policy: str = "forward", initial: int = 2, size: int = 10, metric: str = "auc", most: int = 50, least: int = 5, weight: float = 0.5, seed: int = 7
) -> DataFrame:
    """model, step, user_id: the members of each model's ensemble in the order in which they came, ``size`` at most.

    The first ``initial`` are those with the best scores of their own (smaller names among equals). Then, by the policy: greedy goes on like this;
    forward takes the rater with the best score of the ensemble's mean with it; enhanced does so among ``most`` drawn candidates;
    drep among the ``least`` of these that make the ensemble the least alike; sdi takes the drawn one with the best weighted sum of its own score and
    one less the likeness of the ensemble with it.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}, not {policy}")
    spark, schema = ratings.sparkSession, ratings.select(F.col("fold").alias("model"), F.lit(0).alias("step"), "user_id").schema
    train = stored(held_out(ratings.filter("prediction is not null")))
    own = stored(_score(train, ["model", "user_id"], metric))
    start = size if policy == "greedy" else max(initial, 1)
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("score"), "user_id"))
    chosen = [tuple(r) for r in own.withColumn("step", place).filter(F.col("step") <= min(start, size)).select("model", "step", "user_id").collect()]
    if policy == "greedy" or not chosen:
        return spark.createDataFrame(chosen, schema)
    alike = stored(likeness(ratings.filter("prediction is not null")))
    sums, new = None, chosen
    for step in range(start + 1, size + 1):
        members = spark.createDataFrame(chosen, schema)
        if policy != "sdi":
            added = train.join(spark.createDataFrame(new, schema), ["model", "user_id"]).select("model", "item_id", F.col("prediction").alias("_sum"), F.lit(1).alias("_n"))
            both = added if sums is None else sums.unionByName(added)
            sums = stored(both.groupBy("model", "item_id").agg(F.sum("_sum").alias("_sum"), F.sum("_n").cast("int").alias("_n")))
        best = _next(policy, _candidates(own, members, alike), train, sums, metric, most, least, weight, seed + step)
        new = [(r["model"], step, r["user_id"]) for r in best.select("model", "user_id").collect()]
        if not new:
            break
        chosen = chosen + new
    return spark.createDataFrame(chosen, schema)


def prefixes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """model, size, item_id, label, prediction: means of the first 1, 2, ... members on rows (model, user_id, item_id, prediction, label)."""
    sizes = members.groupBy("model").agg(F.max("step").alias("_last"))
    each = members.join(sizes, "model").select("model", "user_id", F.explode(F.sequence("step", "_last")).alias("size"))
    return rows.join(each, ["model", "user_id"]).groupBy("model", "size", "item_id").agg(F.max("label").alias("label"), F.round(F.avg("prediction"), 9).alias("prediction"))


def growth_curve(ratings: DataFrame, members: DataFrame, metric: str = "auc") -> DataFrame:
    """model, step, user_id, score (of the mean of the members so far), diversity (their mean likeness; null of one)."""
    scores = _score(prefixes(held_out(ratings), members), ["model", "size"], metric).withColumnRenamed("size", "step")
    one, two = (members.select("model", F.col("user_id").alias(x), F.col("step").alias(f"_{x}")) for x in ("a", "b"))
    pairs = likeness(ratings.filter("prediction is not null")).join(one, ["model", "a"]).join(two, ["model", "b"]).filter("_a < _b")
    steps = members.select("model", "step")
    alike = steps.join(pairs, "model").filter(F.col("_b") <= F.col("step")).groupBy("model", "step").agg(F.round(F.avg("rho"), 9).alias("diversity"))
    return members.join(scores, ["model", "step"], "left").join(alike, ["model", "step"], "left")


def held_out_scores(ratings: DataFrame, members: DataFrame, metric: str = "auc") -> DataFrame:
    """fold, item_id, label, prediction, size: each fold's items by the mean of its model's members, up to the size whose mean scores best on the other folds
    (the smallest among equals)."""
    scores = _score(prefixes(held_out(ratings), members), ["model", "size"], metric)
    best = scores.filter("score is not null").groupBy("model").agg(F.min_by("size", F.struct(-F.col("score"), F.col("size"))).alias("size"))
    used = members.join(best, "model").filter(F.col("step") <= F.col("size")).select(F.col("model").alias("fold"), "user_id", "size")
    out = ratings.join(used, ["fold", "user_id"]).groupBy("fold", "item_id")
    return out.agg(F.max("label").alias("label"), F.round(F.avg("prediction"), 9).alias("prediction"), F.max("size").alias("size"))
