"""Level-1 files: predictor files, folds, catalogues of files, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlake.operators import reshape

PREDICTOR_FILE = r"(\w+)-b(\d+)-f(\d+)-s(\d+)\.csv"
FOLD_FILE = r"([\w.]+)-(\w+)-(\d+)\.csv"


def predictor_files(spark: SparkSession, path: str) -> DataFrame:
    """Base predictor files ``valid-b0-f1-s2.csv.gz``: split, bag, fold, seed, id, label, prediction. Comment lines begin with #."""
    rows = spark.read.csv(path, header=True, comment="#", schema="id bigint, label int, prediction double")
    name = F.col("_metadata.file_name")
    part = lambda k: F.regexp_extract(name, PREDICTOR_FILE, k)
    return rows.select(part(1).alias("split"), *(part(k).cast("int").alias(n) for k, n in ((2, "bag"), (3, "fold"), (4, "seed"))), "id", "label", "prediction")


def fold(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Ratings of fold k, train and test, from wide ``validation-k.csv.gz`` and ``predictions-k.csv.gz``."""
    parts = []
    for name, split in (("validation", "train"), ("predictions", "test")):
        wide = spark.read.csv(f"{path}/{name}-{k}.csv*", header=True, inferSchema=True)
        parts.append(reshape.to_long(wide, ["id", "label"]).withColumn("split", F.lit(split)).withColumn("fold", F.lit(k)))
    return parts[0].unionByName(parts[1])


def all_folds(spark: SparkSession, path: str, folds: list[int]) -> DataFrame:
    out = fold(spark, path, folds[0])
    for k in folds[1:]:
        out = out.unionByName(fold(spark, path, k))
    return out


def catalogue(spark: SparkSession, path: str, file_type: str | None = None) -> DataFrame:
    """method, file_type, indices of the files named ``method-type-index.csv`` below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"))
    part = lambda k: F.regexp_extract("name", FOLD_FILE, k)
    out = files.filter(F.col("name").rlike(FOLD_FILE)).select(part(1).alias("method"), part(2).alias("file_type"), part(3).cast("int").alias("index"))
    out = out.filter(F.col("file_type") == file_type) if file_type else out
    return out.groupBy("method", "file_type").agg(F.sort_array(F.collect_set("index")).alias("indices"))


def paired_indices(catalogue: DataFrame, one: str, two: str) -> DataFrame:
    """method, and the indices that files of both types have."""
    a = catalogue.filter(F.col("file_type") == one).select("method", F.col("indices").alias("_a"))
    b = catalogue.filter(F.col("file_type") == two).select("method", F.col("indices").alias("_b"))
    return a.join(b, "method").select("method", F.array_intersect("_a", "_b").alias("indices"))


def properties(text: str) -> dict[str, str]:
    """``key=value`` lines as a dictionary; # begins a comment."""
    pairs = (line.split("#", 1)[0].partition("=") for line in text.splitlines())
    return {k.strip(): v.strip() for k, sep, v in pairs if sep}


def write_ratings(ratings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by fold and split, so that reads of one fold touch its files only."""
    ratings.write.mode(mode).partitionBy("fold", "split").parquet(path)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def count_matrix(spark: SparkSession, path: str, users: int, items: int) -> DataFrame:
    """user, item, n of a tab-separated count matrix, and confidence: n scaled by (empty cells) / (sum of counts). Ids out of range go."""
    rows = spark.read.csv(path, sep="\t", schema="user int, item int, n double").filter((F.col("user") < users) & (F.col("item") < items))
    total = rows.agg(((F.lit(users * items) - F.count("*")) / F.sum("n")).alias("alpha"))
    return rows.crossJoin(F.broadcast(total)).select("user", "item", "n", (F.col("n") * F.col("alpha")).alias("confidence"))


def reindexed(catalogue: DataFrame) -> DataFrame:
    """method, file_type, index, number: indices of each method's files numbered anew from 0 without gaps."""
    return catalogue.select("method", "file_type", F.posexplode("indices").alias("number", "index"))


def resolve(catalogue: DataFrame, method: str, file_type: str) -> list[int]:
    """Indices of the one method whose name begins so; ValueError if none or several do."""
    found = catalogue.filter(F.startswith("method", F.lit(method)) & (F.col("file_type") == file_type)).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'several methods' if found else 'no method'} named {method}* with files of type {file_type}")
    return list(found[0]["indices"])


def write_estimates(ratings: DataFrame, path: str, method: str, kind: str, mode: str = "append") -> None:
    """Prior or posterior ratings (the kind) of a method, partitioned so that reads of one method, kind, fold and split touch its files only."""
    rows = ratings.withColumns({"method": F.lit(method), "kind": F.lit(kind)})
    rows.write.mode(mode).partitionBy("method", "kind", "fold", "split").parquet(path)


def read_estimates(spark: SparkSession, path: str, method: str, kind: str, fold: int | None = None, split: str | None = None) -> DataFrame:
    """What write_estimates wrote of a method and kind, of one fold and split if given."""
    rows = spark.read.parquet(path).filter((F.col("method") == method) & (F.col("kind") == kind))
    rows = rows if fold is None else rows.filter(F.col("fold") == fold)
    return (rows if split is None else rows.filter(F.col("split") == split)).drop("method", "kind")


def prior_and_posterior(spark: SparkSession, path: str, method: str, fold: int) -> DataFrame:
    """Cells of one fold with both estimates: user_id, item_id, label, split, prior, posterior. The split is the prior's."""
    prior, posterior = (read_estimates(spark, path, method, kind, fold) for kind in ("prior", "posterior"))
    both = prior.withColumnRenamed("prediction", "prior").join(posterior.select("user_id", "item_id", F.col("prediction").alias("posterior")), ["user_id", "item_id"])
    return both.select("user_id", "item_id", "label", "split", "prior", "posterior")


def with_preferences(ratings: DataFrame, preferences: DataFrame) -> DataFrame:
    """Ratings, and beside them preferences as further users: kind is rating or preference."""
    p = preferences.select("user_id", "item_id", F.col("preference").cast("double").alias("prediction"), "label")
    return ratings.select("user_id", "item_id", "prediction", "label").withColumn("kind", F.lit("rating")).unionByName(p.withColumn("kind", F.lit("preference")))
