"""Queries of ensemble selection, stacking, neighbourhoods and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from raterlake.operators import cluster, ensembles, metrics, sampling, selection, similarity
from raterlake.plans import workload as W
from raterlake.plans.queries import _C, _KNN, _R, query
from raterlake.plans.workload import with_ctes

#: The ensemble that the next member is chosen for.
_HELD = ["len.0", "sym.0"]


def _auc(source: str, keys: str, score: str, name: str = "auc") -> str:
    """SQL of the area under the ROC curve, from mean ranks."""
    return f"""(SELECT {keys}, round((sum(r) FILTER (label = 1) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * (n - n1)), 6) AS {name} FROM (
  SELECT {keys}, label, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2.0::DOUBLE AS r,
    sum(label) OVER (PARTITION BY {keys}) AS n1, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}) GROUP BY {keys}, n1, n)"""


_CANDIDATES = (
    with_ctes(*_R)
    + f""", held AS (SELECT item_id, avg(prediction) AS m FROM ratings WHERE user_id IN ('len.0', 'sym.0') GROUP BY item_id),
rest AS (SELECT r.*, m, round((m * 2 + prediction) / 3, 9) AS mixed FROM ratings r JOIN held USING (item_id) WHERE user_id NOT IN ('len.0', 'sym.0')),
rho AS (SELECT user_id, round(coalesce(abs((avg(prediction * m) - avg(prediction) * avg(m)) / nullif(stddev_pop(prediction) * stddev_pop(m), 0)), 0), 6) AS correlation FROM rest GROUP BY user_id),
c AS (SELECT user_id, auc, combined_auc, correlation FROM {_auc("rest", "user_id", "prediction")} JOIN {_auc("rest", "user_id", "mixed", "combined_auc")} USING (user_id) JOIN rho USING (user_id))"""
)


@query(_CANDIDATES + " SELECT * FROM c")
def ensemble_candidates(spark, sf_dir):
    return ensembles.candidates(W.ratings(spark, sf_dir), _HELD)


@query(
    _CANDIDATES
    + """ SELECT 'combined' AS policy, * FROM (SELECT * FROM c ORDER BY combined_auc DESC, user_id LIMIT 1)
UNION ALL SELECT 'diversity', * FROM (SELECT * FROM (SELECT * FROM c ORDER BY correlation, user_id LIMIT 5) ORDER BY combined_auc DESC, user_id LIMIT 1)
UNION ALL SELECT 'score_and_diversity', * FROM (SELECT * FROM c ORDER BY round(0.5::DOUBLE * auc + 0.5::DOUBLE * (1 - correlation), 6) DESC, user_id LIMIT 1)"""
)
def next_members(spark, sf_dir):
    """The rater that each policy would add."""
    c = ensembles.candidates(W.ratings(spark, sf_dir), _HELD)
    chosen = {"combined": ensembles.by_combined_score(c), "diversity": ensembles.by_diversity(c), "score_and_diversity": ensembles.by_score_and_diversity(c)}
    one, two, three = (df.withColumn("policy", F.lit(name)) for name, df in chosen.items())
    return one.unionByName(two).unionByName(three)


@query(
    with_ctes(*_R)
    + f""", means AS (SELECT item_id, 'all' AS method, max(label) AS label, round(avg(prediction), 9) AS prediction FROM ratings GROUP BY item_id),
points AS (SELECT prediction AS threshold, count(*) AS n, sum(label) AS p FROM means GROUP BY 1),
curve AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS n_pred, sum(p) OVER () AS n_pos FROM points WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
SELECT 'all' AS method, (SELECT round(max(round(2.0::DOUBLE * tp / (n_pred + n_pos), 9)), 6) FROM curve) AS fmax, auc FROM {_auc("means", "method", "prediction")}"""
)
def full_ensemble(spark, sf_dir):
    """The mean of all raters over all folds at once."""
    means = W.ratings(spark, sf_dir).groupBy("item_id").agg(F.max("label").alias("label"), F.round(F.avg("prediction"), 9).alias("prediction")).withColumn("method", F.lit("all"))
    return metrics.fmax(means, ["method"]).select("method", "fmax").join(metrics.auc(means, ["method"]), "method")


@query(
    with_ctes(*_R)
    + """, s AS (SELECT fold, user_id, count(*)::DOUBLE AS n, sum(prediction) AS x, sum(label)::DOUBLE AS y, sum(prediction * label) AS xy, sum(prediction * prediction) AS xx FROM ratings GROUP BY 1, 2),
o AS (SELECT a.fold, a.user_id, sum(b.n) AS n, sum(b.x) AS x, sum(b.y) AS y, sum(b.xy) AS xy, sum(b.xx) AS xx FROM s a JOIN s b ON a.user_id = b.user_id AND a.fold <> b.fold GROUP BY 1, 2),
w AS (SELECT fold, user_id, CASE WHEN d > 1e-9 THEN (n * xy - x * y) / d ELSE 0 END AS weight FROM (SELECT *, sqrt(greatest(n * xx - x * x, 0)) * sqrt(n * y - y * y) AS d FROM o))
SELECT fold, item_id, max(label) AS label, round(coalesce(sum(weight * prediction) / nullif(sum(abs(weight)), 0), avg(prediction)), 6) + 0.0 AS prediction FROM ratings JOIN w USING (fold, user_id) GROUP BY 1, 2"""
)
def out_of_fold_scores(spark, sf_dir):
    return ensembles.out_of_fold(W.ratings(spark, sf_dir))


@query()
def nonnegative_stacking(spark, sf_dir):
    """Scores of each fold's items by non-negative weights of the other folds; the weights are tested against all subsets of raters."""
    r = W.ratings(spark, sf_dir)
    return ensembles.stacked(r, ensembles.nonnegative_weights(r))


_COSINE = with_ctes(*_R) + """, s AS (SELECT a.user_id AS a, b.user_id AS b, sum(a.prediction * b.prediction) / greatest(sqrt(sum(a.prediction ** 2)) * sqrt(sum(b.prediction ** 2)), 1e-9) AS similarity
  FROM ratings a JOIN ratings b USING (item_id) GROUP BY 1, 2)"""


@query(
    _COSINE
    + """, near AS (SELECT * FROM s WHERE split_part(a, '.', 1) = split_part(b, '.', 1))
SELECT a AS user_id, item_id, round(sum(similarity * prediction) / nullif(sum(abs(similarity)), 0), 6) AS predicted FROM near JOIN ratings ON b = user_id GROUP BY 1, 2"""
)
def cluster_prediction(spark, sf_dir):
    """Cells from the bags of the same rater."""
    r = W.ratings(spark, sf_dir)
    clusters = r.select("user_id").distinct().withColumn("cluster", F.split_part("user_id", F.lit("."), F.lit(1)))
    return similarity.predict_by_cluster(r, similarity.cosine(r), clusters)


@query(
    _COSINE
    + """, d AS (SELECT a, b, round(1 - similarity, 9) AS distance FROM s),
k AS (SELECT a, distance AS s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS i FROM d WHERE a <> b) WHERE i = 3)
SELECT d.a, d.b, round(CASE WHEN d.a = d.b THEN 0 ELSE exp(-coalesce(distance * distance / nullif(x.s * y.s, 0), 0)) END, 6) AS affinity FROM d LEFT JOIN k x ON d.a = x.a LEFT JOIN k y ON d.b = y.a"""
)
def rater_affinity(spark, sf_dir):
    d = similarity.cosine(W.ratings(spark, sf_dir)).select("a", "b", F.round(1 - F.col("similarity"), 9).alias("distance"))
    return similarity.self_tuning_affinity(d, 3)


_NEAR = _KNN.replace("WITH ", ", ", 1) + ", near AS (SELECT query, neighbor FROM n WHERE rank <= 5)"


def _near(spark, sf_dir):
    """Neighbours of vectors stand for those of the documents with their ids."""
    e = W.table(spark, sf_dir, "embeddings")
    return similarity.nearest(e.filter(F.col("vec_id") % 20 == 0), e, 5, "vec_id", "vec_id", "embedding")


@query(
    with_ctes(*_C)
    + _NEAR
    + """, t AS (SELECT query, count(*) FILTER (color = 2) AS tp, count(*) FILTER (color = 1) AS tn, count(*) FILTER (color = -2) AS fp, count(*) FILTER (color = -1) AS fn FROM near JOIN colored ON neighbor = item_id GROUP BY query)
SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS right_positive, round(tn::DOUBLE / nullif(tn + fn, 0), 6) AS right_negative FROM t"""
)
def neighbor_profiles(spark, sf_dir):
    return similarity.neighbor_profile(_near(spark, sf_dir), W.colored(spark, sf_dir))


@query(
    with_ctes(*_C)
    + _NEAR
    + """, g AS (SELECT 1 AS guess UNION ALL SELECT 0),
e AS (SELECT query, neighbor, guess, count(*) FILTER (c.color <> CASE WHEN guess = 1 THEN CASE WHEN v.vote = 1 THEN 2 ELSE -1 END ELSE CASE WHEN v.vote = 1 THEN -2 ELSE 1 END END) AS off
  FROM near JOIN voted v ON v.item_id = query JOIN colored c ON c.item_id = neighbor AND c.user_id = v.user_id CROSS JOIN g GROUP BY 1, 2, 3),
h AS (SELECT query, guess, count(*) FILTER (off = 0) AS exact, CAST(sum(off) AS BIGINT) AS distance FROM e GROUP BY 1, 2)
SELECT query, exact, distance, CAST(guess AS INT) AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY exact DESC, distance, guess DESC) AS i FROM h) WHERE i = 1"""
)
def neighbor_matching(spark, sf_dir):
    v = W.voted(spark, sf_dir)
    return similarity.labels_by_matching(_near(spark, sf_dir), v, W.colored(spark, sf_dir))


@query(
    with_ctes(*_R)
    + """, k AS (SELECT user_id, fold, count(*) AS n, avg(prediction) AS mean FROM ratings WHERE prediction >= 0.5 GROUP BY 1, 2)
SELECT user_id, fold, CAST(row_number() OVER (PARTITION BY user_id ORDER BY fold) - 1 AS INT) AS index, n,
  CAST(row_number() OVER (ORDER BY round(mean, 6) DESC, user_id DESC, fold DESC) AS INT) AS place, round(mean, 6) AS mean FROM k"""
)
def reindexed_folds(spark, sf_dir):
    """Folds with high scores, numbered anew without gaps for each rater, and their place by mean score."""
    k = W.ratings(spark, sf_dir).filter("prediction >= 0.5").groupBy("user_id", "fold").agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 6).alias("mean"))
    place = F.row_number().over(Window.orderBy(F.desc("mean"), F.desc("user_id"), F.desc("fold")))
    return k.withColumns({"index": F.row_number().over(Window.partitionBy("user_id").orderBy("fold")) - 1, "place": place})


@query(
    with_ctes(*_R, "curve", "fmax")
    + f""", a AS {_auc("ratings", "user_id", "prediction")}, m AS (SELECT user_id, round(f, 6) AS fmax FROM fmax)
SELECT metric, {", ".join(f"max(value) FILTER (user_id = '{u}') AS {u.replace('.', '_')}" for u in W.USERS)}
FROM (SELECT user_id, 'auc' AS metric, auc AS value FROM a UNION ALL SELECT user_id, 'fmax', fmax FROM m) GROUP BY metric"""
)
def merged_metrics(spark, sf_dir):
    """Metric tables of all raters side by side, one column for each."""
    r = W.ratings(spark, sf_dir)
    wide = metrics.auc(r, ["user_id"]).join(metrics.fmax(r, ["user_id"]).select("user_id", "fmax"), "user_id", "full")
    long = selection.long_metrics(wide, ["user_id"], ["auc", "fmax"])
    return long.groupBy("metric").pivot("user_id", W.USERS).agg(F.max("value")).withColumnsRenamed({u: u.replace(".", "_") for u in W.USERS})


@query(
    with_ctes(*_R)
    + """, i AS (SELECT item_id, max(label) AS label, max(fold) AS fold FROM ratings GROUP BY item_id), c AS (SELECT label, count(*) AS n FROM i GROUP BY label),
t AS (SELECT label, n, sum(n) OVER () AS total, count(*) OVER () AS classes FROM c),
f AS (SELECT fold, label, count(*) AS n FROM i GROUP BY 1, 2), d AS (SELECT label, sum(n) AS n, round(sum(n) * 0.25::DOUBLE) AS dev FROM f WHERE fold <> 0 GROUP BY label)
SELECT 'proportional' AS sample, label, CAST(least(n, round(100.0::DOUBLE * n / total)) AS BIGINT) AS n FROM t
UNION ALL SELECT 'uniform', label, CAST(least(n, round(100.0::DOUBLE / classes)) AS BIGINT) FROM t
UNION ALL SELECT 'test', label, n FROM f WHERE fold = 0
UNION ALL SELECT 'dev', label, CAST(dev AS BIGINT) FROM d WHERE dev > 0 UNION ALL SELECT 'train', label, CAST(n - dev AS BIGINT) FROM d WHERE n > dev"""
)
def class_samples(spark, sf_dir):
    """Rows of each class in samples of 100 and in a split by fold with a dev share of 0.2 of all."""
    items = W.ratings(spark, sf_dir).groupBy("item_id").agg(F.max("label").alias("label"), F.max("fold").alias("fold"))
    samples = [sampling.class_sample(items, 100, uniform).withColumn("sample", F.lit(name)) for name, uniform in (("proportional", False), ("uniform", True))]
    split = sampling.fold_and_dev(items, 0, 5, 0.2).withColumnRenamed("split", "sample")
    return samples[0].unionByName(samples[1]).unionByName(split.select(samples[0].columns)).groupBy("sample", "label").agg(F.count("*").alias("n"))


@query(
    with_ctes(*_C)
    + _NEAR
    + """, k AS (SELECT item_id, color, count(*) AS c, max(label) AS label FROM colored GROUP BY 1, 2),
h AS (SELECT item_id, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) + 0.0 AS entropy, max(label) AS label FROM k GROUP BY 1)
SELECT query, CAST(avg(label) >= 0.5 AS INT) AS predicted FROM (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY entropy, item_id) AS i FROM near JOIN h ON neighbor = item_id) WHERE i <= 3 GROUP BY query"""
)
def neighbor_rank_labels(spark, sf_dir):
    return similarity.labels_by_rank(_near(spark, sf_dir), W.colored(spark, sf_dir))


@query()
def silhouette_by_k(spark, sf_dir):
    return cluster.silhouettes(W.table(spark, sf_dir, "embeddings"), "embedding", [2, 4, 8])


@query()
def gap_by_k(spark, sf_dir):
    return cluster.gap_statistics(W.table(spark, sf_dir, "embeddings").select("embedding"), "embedding", [2, 4, 8], references=2)
