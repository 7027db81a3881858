"""Clusters: assignment, centres, quality, densities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlake.functions import arrays


def centers(points: DataFrame, cluster: str, vector: str) -> DataFrame:
    """The mean vector of each cluster."""
    each = points.select(cluster, F.posexplode(vector).alias("pos", "x"))
    means = each.groupBy(cluster, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return means.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("center"))


def assign(points: DataFrame, centers: DataFrame, id_col: str, vector: str, cluster: str) -> DataFrame:
    """The nearest centre of each point (the smallest name among equals) and the squared distance."""
    c = centers.select(F.col(cluster).alias("nearest"), "center")
    d = points.select(id_col, vector).crossJoin(c).withColumn("distance", F.round(arrays.squared_distance(F.col(vector), F.col("center")), 6))
    return d.groupBy(id_col).agg(F.min_by("nearest", F.struct("distance", "nearest")).alias("nearest"), F.min("distance").alias("distance"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """One row from a contingency table: homogeneity, completeness, V measure, adjusted Rand index."""
    t = table.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b")), "all": F.sum("n").over(Window.partitionBy())})
    p, pa, pb = F.col("n") / F.col("all"), F.col("na") / F.col("all"), F.col("nb") / F.col("all")
    pairs = lambda x: x * (x - 1) / 2.0
    s = t.agg(
        (-F.sum(p * F.ln(p / pa))).alias("h_b_given_a"),
        (-F.sum(p * F.ln(p / pb))).alias("h_a_given_b"),
        (-F.sum(p * F.ln(pa))).alias("h_a"),
        (-F.sum(p * F.ln(pb))).alias("h_b"),
        F.sum(pairs(F.col("n"))).alias("both"),
        F.sum(pairs(F.col("na")) * F.col("n") / F.col("na")).alias("in_a"),
        F.sum(pairs(F.col("nb")) * F.col("n") / F.col("nb")).alias("in_b"),
        pairs(F.max("all")).alias("total"),
    )
    hom = 1 - F.coalesce(F.try_divide("h_a_given_b", "h_a"), F.lit(0.0))
    com = 1 - F.coalesce(F.try_divide("h_b_given_a", "h_b"), F.lit(0.0))
    expected = F.col("in_a") * F.col("in_b") / F.col("total")
    ari = F.try_divide(F.col("both") - expected, (F.col("in_a") + F.col("in_b")) / 2 - expected)
    return s.select(hom.alias("homogeneity"), com.alias("completeness"), F.try_divide(2 * hom * com, hom + com).alias("v_measure"), ari.alias("adjusted_rand"))


def dispersion(points: DataFrame, centers: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Within-cluster dispersion: the sum of squared distances over twice the size, for each cluster."""
    d = points.join(F.broadcast(centers), cluster).withColumn("_d", arrays.squared_distance(F.col(vector), F.col("center")))
    return d.groupBy(cluster).agg((F.sum("_d") / (2 * F.count("*"))).alias("dispersion"), F.count("*").alias("size"))


def label_shares(df: DataFrame, cluster: str, label: str) -> DataFrame:
    counts = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(cluster)))


def kernel_density(df: DataFrame, value: str, width: float, low: float, high: float, grid: int = 50) -> DataFrame:
    """x, density: a Gaussian kernel estimate on a grid of fixed size; each row adds to each grid point, with partial sums."""
    step = (high - low) / (grid - 1)
    points = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("k"))
    x = low + F.col("k") * step
    return points.groupBy("k").agg(F.avg(F.exp(-F.pow((x - F.col("v")) / width, F.lit(2)) / 2) / (width * 2.5066282746310002)).alias("density")).select((low + F.col("k") * step).alias("x"), "density")


def kmeans(points: DataFrame, vector: str, k: int, seed: int = 7):
    """MLlib's k-means over an array column: the model, and the points with prediction."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = points.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed).fit(ready)
    return model, model.transform(ready).drop("features")


def silhouettes(points: DataFrame, vector: str, ks: list[int], seed: int = 7) -> DataFrame:
    """k, silhouette (squared Euclidean) of k-means for each k. Only one number for each k comes to the driver."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    out = []
    for k in ks:
        assigned = kmeans(points, vector, k, seed)[1].withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
        out.append((k, float(evaluator.evaluate(assigned))))
    return points.sparkSession.createDataFrame(out, "k int, silhouette double")


def uniform_reference(points: DataFrame, vector: str, seed: int) -> DataFrame:
    """As many points with each coordinate uniform between the least and the largest of the points; the draws hash the point, its repeats and the
    coordinate, so they don't depend on partitions."""
    each = points.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.min(F.col("x").cast("double")).alias("low"), F.max(F.col("x").cast("double")).alias("high"))
    box = each.agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("_box"))
    # Equal points are counted, then made anew by number.
    counted = points.groupBy(F.col(vector).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    draw = lambda b: F.pmod(F.xxhash64("_v", "_i", b["pos"], F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return counted.crossJoin(box).select(F.transform("_box", lambda b: b["low"] + (b["high"] - b["low"]) * draw(b)).alias(vector))


def inertia(points: DataFrame, vector: str, k: int, seed: int = 7) -> float:
    """The sum of squared distances to k-means' centres; for one cluster, to the mean."""
    if k > 1:
        return float(kmeans(points, vector, k, seed)[0].summary.trainingCost)
    each = points.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg((F.var_pop(F.col("x").cast("double")) * F.count("x")).alias("s"))
    return float(each.agg(F.sum("s")).first()[0] or 0.0)


def gap_statistics(points: DataFrame, vector: str, ks: list[int], references: int = 5, seed: int = 7) -> DataFrame:
    """k, gap, spread, gap_of_mean, chosen: the mean log inertia of uniform references less that of the points, and its spread times
    sqrt(1 + 1 / references); the same with the log of the mean inertia, and whether that is the largest of all (the smallest k among equals)."""
    import math

    log_inertia = lambda df, k: math.log(max(inertia(df, vector, k, seed), 1e-300))
    made = [uniform_reference(points, vector, seed + r) for r in range(references)]
    rows = []
    for k in ks:
        logs, own = [log_inertia(df, k) for df in made], log_inertia(points, k)
        mean = sum(logs) / references
        spread = math.sqrt(sum((x - mean) ** 2 for x in logs) / references * (1 + 1 / references))
        rows.append((k, mean - own, spread, math.log(sum(map(math.exp, logs)) / references) - own))
    chosen = max(rows, key=lambda r: (r[3], -r[0]))[0]
    return points.sparkSession.createDataFrame([(*r, r[0] == chosen) for r in rows], "k int, gap double, spread double, gap_of_mean double, chosen boolean")
