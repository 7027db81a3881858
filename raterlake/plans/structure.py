"""Queries of undersampling, spectral clusters, and functions of strings and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from raterlake.functions import arrays
from raterlake.operators import similarity, spectral, undersampling
from raterlake.plans import workload as W
from raterlake.plans.queries import query


def _points(spark, sf_dir):
    """Vectors; those of label 0 are the smaller class."""
    e = W.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("label") == 0).cast("int").alias("label"))


_D = """WITH p AS (SELECT vec_id AS id, embedding AS v, (label = 0)::INT AS label FROM embeddings),
d AS (SELECT a.id, b.id AS neighbor, a.label, b.label AS other, greatest(round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 6), 0) AS d
  FROM p a JOIN p b ON a.id <> b.id)"""


@query(
    _D
    + """, c AS (SELECT DISTINCT neighbor AS id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor) AS r FROM d WHERE label = 1 AND other = 0) WHERE r <= 3),
m AS (SELECT id, round(avg(sqrt(d)), 6) AS m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor) AS r FROM d WHERE label = 0 AND other = 1 AND id IN (SELECT id FROM c)) WHERE r <= 3 GROUP BY id),
s AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY m DESC, id) AS r FROM m) WHERE r <= (SELECT sum(label) FROM p))
SELECT id, label FROM p WHERE label = 1 OR id IN (SELECT id FROM s)"""
)
def near_miss_sample(spark, sf_dir):
    return undersampling.near_miss(_points(spark, sf_dir), 1).select("id", "label")


@query(
    _D
    + """, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor) AS r FROM d) WHERE r <= 3),
x AS (SELECT id, label FROM n GROUP BY id, label HAVING 2 * count(*) FILTER (other <> label) > count(*))
SELECT id, label FROM p WHERE id NOT IN (SELECT id FROM x WHERE label = 0) AND id NOT IN (SELECT neighbor FROM n WHERE other = 0 AND id IN (SELECT id FROM x WHERE label = 1))"""
)
def cleaned_neighborhoods(spark, sf_dir):
    return undersampling.cleaned(_points(spark, sf_dir), 1).select("id", "label")


@query()
def spectral_clusters(spark, sf_dir):
    """Clusters of all vectors by their nearest neighbours."""
    return spectral.clusters(spectral.neighbour_affinity(_points(spark, sf_dir).select("id", "vector"), 10), 10, inner=6, most=8)


@query()
def spectral_raters(spark, sf_dir):
    return spectral.rater_clusters(similarity.cosine(W.ratings(spark, sf_dir)), 3, inner=6, most=8)


@query(
    """WITH s AS (SELECT p_partkey, p_name AS a, lower(p_type) AS b FROM part),
i AS (SELECT p_partkey, a, b, unnest(range(1, length(a) + 1)) AS e FROM s),
c AS (SELECT p_partkey, e, n, substr(a, e - n + 1, n) AS x FROM (SELECT *, unnest(range(1, e + 1)) AS n FROM i) WHERE contains(b, substr(a, e - n + 1, n))),
t AS (SELECT p_partkey, max_by(x, (n, -e)) AS x FROM c GROUP BY 1)
SELECT p_partkey, coalesce(x, '') AS common FROM s LEFT JOIN t USING (p_partkey)"""
)
def common_substrings(spark, sf_dir):
    """The longest run of characters that the name and the type of a part share, in small letters."""
    return W.table(spark, sf_dir, "part").select("p_partkey", arrays.longest_common_substring(F.col("p_name"), F.lower("p_type")).alias("common"))


@query(
    """WITH a AS (SELECT r_regionkey, list(n_name ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
i AS (SELECT r_regionkey, names, unnest(range(1, len(names) + 1)) AS i FROM a), j AS (SELECT *, unnest(range(i + 1, len(names) + 1)) AS j FROM i), k AS (SELECT *, unnest(range(j + 1, len(names) + 1)) AS k FROM j)
SELECT r_regionkey, names[i] || ',' || names[j] || ',' || names[k] AS three FROM k"""
)
def nation_triples(spark, sf_dir):
    """All choices of three nations of a region."""
    n, r = W.table(spark, sf_dir, "nation"), W.table(spark, sf_dir, "region")
    names = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return names.select("r_regionkey", F.explode(arrays.combinations(F.col("names"), 3)).alias("c")).select("r_regionkey", F.array_join("c", ",").alias("three"))
