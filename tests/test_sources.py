"""Catalogues, estimates written and read again, clusters by k, and draws."""

import pytest
from pyspark.sql import functions as F

from raterlake.operators import cluster, sampling
from raterlake.sources import level1


def test_catalogue_numbers_and_names(spark):
    c = spark.createDataFrame([("nmf.1", "prior", [2, 5, 9]), ("nmf.2", "prior", [0]), ("knn", "prior", [4])], "method string, file_type string, indices array<int>")
    got = [(r["number"], r["index"]) for r in level1.reindexed(c).filter("method = 'nmf.1'").orderBy("number").collect()]
    assert got == [(0, 2), (1, 5), (2, 9)]
    assert level1.resolve(c, "knn", "prior") == [4]
    for name in ("nmf", "svd"):
        with pytest.raises(ValueError):
            level1.resolve(c, name, "prior")


def test_estimates_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/estimates"
    rows = [("u", i, i / 10, i % 2, i % 3, "test" if i > 4 else "train") for i in range(9)]
    prior = spark.createDataFrame(rows, "user_id string, item_id long, prediction double, label int, fold int, split string")
    level1.write_estimates(prior, path, "als", "prior")
    level1.write_estimates(prior.withColumn("prediction", 1 - F.col("prediction")), path, "als", "posterior")
    both = level1.prior_and_posterior(spark, path, "als", 1).orderBy("item_id").collect()
    assert [(r["item_id"], r["prior"], round(r["posterior"], 6), r["split"]) for r in both] == [(1, 0.1, 0.9, "train"), (4, 0.4, 0.6, "train"), (7, 0.7, 0.3, "test")]
    assert level1.read_estimates(spark, path, "als", "prior", 1, "test").count() == 1
    assert level1.read_estimates(spark, path, "nmf", "prior").count() == 0
    doubled = level1.with_preferences(prior, prior.select("user_id", "item_id", F.lit(1).alias("preference"), "label"))
    assert {(r["kind"], r["count"]) for r in doubled.groupBy("kind").count().collect()} == {("rating", 9), ("preference", 9)}


def test_k_of_three_blobs(spark):
    points = [[10.0 * (i % 3) + (i % 7) / 10, 10.0 * (i % 3 == 1) + (i % 5) / 10] for i in range(90)]
    df = spark.createDataFrame([(p,) for p in points], "v array<double>")
    found = {r["k"]: r["silhouette"] for r in cluster.silhouettes(df, "v", [2, 3, 4]).collect()}
    assert max(found, key=found.get) == 3
    assert [r["k"] for r in cluster.gap_statistics(df, "v", [1, 2, 3, 4], references=3).filter("chosen").collect()] == [3]
    reference = cluster.uniform_reference(df, "v", 1)
    assert reference.count() == 90 and 0 <= reference.agg(F.min(F.get("v", F.lit(0)))).first()[0]


def test_weighted_choice_follows_the_weights(spark):
    df = spark.range(3000).select(F.col("id").alias("g"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("w")) for n, w in (("a", 1.0), ("b", 3.0), ("c", 0.0))))).alias("x")).select("g", "x.*")
    got = {r["name"]: r["count"] for r in sampling.weighted_choice(df, ["g"], "w", "name").groupBy("name").count().collect()}
    assert set(got) == {"a", "b"} and sum(got.values()) == 3000 and abs(got["b"] - 2250) < 120


def test_bootstrap_leaves_rows_out_of_the_bag(spark):
    times = sampling.bootstrap_with_rest(spark.range(4000), "id", 2).groupBy("repetition").agg(F.avg("times").alias("mean"), F.avg((F.col("times") == 0).cast("int")).alias("out")).collect()
    assert all(abs(r["mean"] - 1) < 0.06 and abs(r["out"] - 0.368) < 0.03 for r in times) and len(times) == 2
