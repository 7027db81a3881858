"""Similarities of raters and items, prediction from neighbours, nearest neighbours of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.functions import arrays, scalar
from raterlake.operators import topk


def cosine(ratings: DataFrame, of: str = "user_id", over: str = "item_id", value: str = "prediction", epsilon: float = 1e-9) -> DataFrame:
    """a, b, similarity of all pairs of raters by the cosine of their scores of the same items. Joined on the long axis, so each
    item gives the square of its raters; meant for the short axis."""
    r = ratings.select(F.col(of).alias("a"), F.col(over).alias("k"), F.col(value).alias("x"))
    s = ratings.select(F.col(of).alias("b"), F.col(over).alias("k"), F.col(value).alias("y"))
    sums = r.join(s, "k").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return sums.select("a", "b", (F.col("xy") / F.greatest(F.sqrt("xx") * F.sqrt("yy"), F.lit(epsilon))).alias("similarity"))


def pearson(ratings: DataFrame, of: str = "user_id", over: str = "item_id", value: str = "prediction") -> DataFrame:
    """a, b, correlation and distance sqrt(1 - correlation) of all pairs of raters; null where one is constant."""
    r = ratings.select(F.col(of).alias("a"), F.col(over).alias("k"), F.col(value).alias("x"))
    s = ratings.select(F.col(of).alias("b"), F.col(over).alias("k"), F.col(value).alias("y"))
    x, y = F.col("x"), F.col("y")
    c = r.join(s, "k").groupBy("a", "b").agg((F.avg(x * y) - F.avg(x) * F.avg(y)).alias("c"), (F.stddev_pop(x) * F.stddev_pop(y)).alias("s"))
    rho = F.least(F.greatest(F.try_divide("c", "s"), F.lit(-1.0)), F.lit(1.0))
    return c.select("a", "b", rho.alias("correlation"), F.sqrt(1 - rho).alias("distance"))


def diversity(ratings: DataFrame) -> DataFrame:
    """One row: the mean absolute correlation of different raters."""
    return pearson(ratings).filter("a < b").agg(F.avg(F.abs("correlation")).alias("average_pearson"), F.count("*").alias("pairs"))


def predict_topk(ratings: DataFrame, similarity: DataFrame, k: int = 3, debiased: bool = False) -> DataFrame:
    """Each cell from the k raters most similar to its own (itself included, smaller names among equals): the mean of their scores,
    weighted by similarity; debiased, of their scores less their means, plus the rater's own mean."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    near = similarity.withColumn("_k", rank).filter(F.col("_k") <= k).select("a", "b", "similarity")
    means = ratings.groupBy("user_id").agg(F.avg("prediction").alias("mean"))
    others = ratings.join(F.broadcast(means), "user_id").select(F.col("user_id").alias("b"), "item_id", (F.col("prediction") - (F.col("mean") if debiased else 0.0)).alias("x"))
    mixed = others.join(near, "b").groupBy(F.col("a").alias("user_id"), "item_id").agg(F.try_divide(F.sum(F.col("similarity") * F.col("x")), F.sum(F.abs("similarity"))).alias("x"))
    out = mixed.join(means, "user_id")
    return out.select("user_id", "item_id", (F.col("x") + (F.col("mean") if debiased else 0.0)).alias("predicted"))


def predict_by_label_correlation(ratings: DataFrame) -> DataFrame:
    """Items scored by the raters' scores, weighted by their correlation with the labels."""
    y, p = F.col("label"), F.col("prediction")
    rho = ratings.groupBy("user_id").agg(F.coalesce(F.try_divide(F.avg(y * p) - F.avg(y) * F.avg(p), F.stddev_pop(y) * F.stddev_pop(p)), F.lit(0.0)).alias("rho"))
    joined = ratings.join(F.broadcast(rho), "user_id")
    return joined.groupBy("item_id").agg(F.try_divide(F.sum(F.col("rho") * p), F.sum(F.abs("rho"))).alias("score"))


def nearest(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, vector: str) -> DataFrame:
    """The k nearest points of each query by squared distance (smaller ids among equals), the query itself left out. Exact: each block of queries
    meets each block of points once, and only the k best of each go on."""
    q, p = queries.select(F.col(query_id).alias("id"), F.col(vector).alias("vector")), points.select(F.col(point_id).alias("id"), F.col(vector).alias("vector"))
    return topk.best_pairs(q, p, k, "distance", not_itself=True).withColumnRenamed("value", "distance")


def knn_labels(neighbors: DataFrame, labels: DataFrame) -> DataFrame:
    """The label most neighbours of a query have, the smallest among equals. labels: neighbor, label."""
    counts = neighbors.join(labels, "neighbor").groupBy("query", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("query").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("predicted"))


def unseen(users: DataFrame, items: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs of the given users and items that no row of seen has."""
    return users.select("user_id").crossJoin(items.select("item_id")).join(seen, ["user_id", "item_id"], "left_anti")


def vector_similarity(a: Column, b: Column) -> Column:
    return arrays.cosine(a, b)


def predict_by_cluster(ratings: DataFrame, similarity: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each cell from the raters of its own one's cluster (itself included), weighted by similarity. clusters: user_id, cluster."""
    a, b = (clusters.select(F.col("user_id").alias(x), "cluster") for x in ("a", "b"))
    near = similarity.join(a, "a").join(b, ["b", "cluster"]).select("a", "b", "similarity")
    mixed = ratings.withColumnRenamed("user_id", "b").join(near, "b")
    return mixed.groupBy(F.col("a").alias("user_id"), "item_id").agg(F.try_divide(F.sum(F.col("similarity") * F.col("prediction")), F.sum(F.abs("similarity"))).alias("predicted"))


def self_tuning_affinity(distances: DataFrame, k: int) -> DataFrame:
    """a, b, affinity from a, b, distance: exp(-d^2 / (s_a s_b)), where s is the distance to the k-th neighbour; 0 of a point to itself."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))
    scale = distances.filter("a <> b").withColumn("_k", rank).filter(F.col("_k") == k).select("a", F.col("distance").alias("_s"))
    both = distances.join(scale, "a", "left").join(scale.select(F.col("a").alias("b"), F.col("_s").alias("_t")), "b", "left")
    near = F.exp(-F.coalesce(F.try_divide(F.col("distance") * F.col("distance"), F.col("_s") * F.col("_t")), F.lit(0.0)))
    return both.select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(near).alias("affinity"))


def neighbor_profile(neighbors: DataFrame, colored: DataFrame) -> DataFrame:
    """query, and how many cells of its neighbours are true or false positives or negatives, with the share of right ones among each vote
    (null without such votes)."""
    cells = neighbors.select("query", F.col("neighbor").alias("item_id")).join(colored.select("item_id", "color"), "item_id")
    n = lambda color: F.count_if(F.col("color") == color)
    out = cells.groupBy("query").agg(n(2).alias("tp"), n(1).alias("tn"), n(-2).alias("fp"), n(-1).alias("fn"))
    right = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return out.withColumns({"right_positive": right("tp", "fp"), "right_negative": right("tn", "fn")})


def labels_by_matching(neighbors: DataFrame, voted: DataFrame, colored: DataFrame) -> DataFrame:
    """query, exact, distance, predicted: each label gives a query's votes a row of colours, compared with the colours of its neighbours.
    The label that more neighbours match exactly wins, else the one with fewer differing cells in all, then 1.

    exact and distance are those of the label predicted.
    """
    cells = voted.select(F.col("item_id").alias("query"), "user_id", "vote")
    theirs = colored.select(F.col("item_id").alias("neighbor"), "user_id", "color")
    pairs = neighbors.select("query", "neighbor").join(cells, "query").join(theirs, ["neighbor", "user_id"])
    tried = pairs.withColumn("guess", F.explode(F.array(F.lit(1), F.lit(0))))
    off = F.count_if(F.col("color") != scalar.color(F.col("guess"), F.col("vote"))).alias("off")
    each = tried.groupBy("query", "neighbor", "guess").agg(off)
    whole = each.groupBy("query", "guess").agg(F.count_if(F.col("off") == 0).alias("exact"), F.sum("off").alias("distance"))
    best = F.min(F.struct((-F.col("exact")).alias("e"), F.col("distance").alias("d"), (-F.col("guess")).alias("g")))
    return whole.groupBy("query").agg(best.alias("m")).select("query", (-F.col("m.e")).alias("exact"), F.col("m.d").alias("distance"), (-F.col("m.g")).alias("predicted"))


def labels_by_rank(neighbors: DataFrame, colored: DataFrame, n: int = 3) -> DataFrame:
    """query, predicted: the label that most of the n neighbours with the lowest entropy of colours have, 1 among equals. Entropies are compared
    with six digits, smaller ids first among equals."""
    counts = colored.groupBy("item_id", "color").agg(F.count("*").alias("n"), F.max("label").alias("label"))
    # Of the counts c of an item's N cells, the entropy is ln N - sum(c ln c) / N.
    entropy = F.round(F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n"), 6) + 0.0
    items = counts.groupBy(F.col("item_id").alias("neighbor")).agg(entropy.alias("entropy"), F.max("label").alias("label"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("entropy", "neighbor"))
    top = neighbors.select("query", "neighbor").join(items, "neighbor").withColumn("_k", rank).filter(F.col("_k") <= n)
    return top.groupBy("query").agg((F.avg("label") >= 0.5).cast("int").alias("predicted"))
