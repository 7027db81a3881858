"""Ratings, implicit feedback, vectors and text out of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlake.operators import labels, metrics

USERS = ["len.0", "len.1", "space.0", "space.1", "sym.0", "sym.1", "uniq.0", "uniq.1", "upper.0"]
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = "#*$%&|<>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine simple raters of the labelled documents; label 1 for junk (quality 0), fold = doc_id % 5."""
    t = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    words = F.split(t, " ")
    base = docs.select(
        F.col("doc_id").alias("item_id"),
        (1 - F.col("quality")).cast("int").alias("label"),
        F.pmod("doc_id", F.lit(5)).cast("int").alias("fold"),
        n.alias("n"),
        (without(" ") / n).alias("space"),
        (without(_SYMBOLS) / n).alias("sym"),
        (without(_CAPITALS) / n).alias("upper"),
        (F.size(F.array_distinct(words)) / F.size(words).cast("double")).alias("uniq"),
    )
    one = F.lit(1.0)
    scores = {
        "len.0": F.least(F.col("n") / 4000.0, one),
        "len.1": F.least(F.col("n") / 8000.0, one),
        "space.0": F.col("space"),
        "space.1": F.least(F.abs(F.col("space") - 0.15) * 5.0, one),
        "sym.0": F.least(F.col("sym") * 4.0, one),
        "sym.1": F.least(F.col("sym") * 10.0, one),
        "uniq.0": 1.0 - F.col("uniq"),
        "uniq.1": F.least((1.0 - F.col("uniq")) * 1.5, one),
        "upper.0": F.col("upper"),
    }
    cells = F.explode(F.array(*(F.struct(F.lit(u).alias("user_id"), F.round(x, 6).alias("prediction")) for u, x in scores.items())))
    return base.select("item_id", "label", "fold", cells.alias("_c")).select("_c.user_id", "item_id", "_c.prediction", "label", "fold")


def voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    return labels.votes(r, metrics.thresholds(r, ["user_id"]))


def colored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.colored(voted(spark, sf_dir))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item, n: quantities that customers ordered of parts."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = o.join(i, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").cast("double").alias("n"))


#: The same relations in SQL, as common table expressions that build on each other.
CTE: dict[str, str] = {
    "base": f"""
base AS (
  SELECT doc_id AS item_id, CAST(1 - quality AS INT) AS label, CAST(doc_id % 5 AS INT) AS fold, greatest(length(t), 1) * 1.0::DOUBLE AS n,
    (length(t) - length(replace(t, ' ', ''))) / greatest(length(t), 1)::DOUBLE AS space,
    (length(t) - length(translate(t, '{_SYMBOLS}', ''))) / greatest(length(t), 1)::DOUBLE AS sym,
    (length(t) - length(translate(t, '{_CAPITALS}', ''))) / greatest(length(t), 1)::DOUBLE AS upper,
    len(list_distinct(string_split(t, ' '))) / len(string_split(t, ' '))::DOUBLE AS uniq
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) JOIN labels USING (doc_id))""",
    "ratings": """
ratings AS (
  SELECT u.user_id, item_id, round(u.prediction, 6) AS prediction, label, fold FROM (
    SELECT item_id, label, fold, unnest([
      {'user_id': 'len.0', 'prediction': least(n / 4000.0::DOUBLE, 1.0::DOUBLE)}, {'user_id': 'len.1', 'prediction': least(n / 8000.0::DOUBLE, 1.0::DOUBLE)},
      {'user_id': 'space.0', 'prediction': space}, {'user_id': 'space.1', 'prediction': least(abs(space - 0.15::DOUBLE) * 5.0::DOUBLE, 1.0::DOUBLE)},
      {'user_id': 'sym.0', 'prediction': least(sym * 4.0::DOUBLE, 1.0::DOUBLE)}, {'user_id': 'sym.1', 'prediction': least(sym * 10.0::DOUBLE, 1.0::DOUBLE)},
      {'user_id': 'uniq.0', 'prediction': 1.0::DOUBLE - uniq}, {'user_id': 'uniq.1', 'prediction': least((1.0::DOUBLE - uniq) * 1.5::DOUBLE, 1.0::DOUBLE)},
      {'user_id': 'upper.0', 'prediction': upper}]) AS u FROM base))""",
    "curve": """
points AS (SELECT user_id, prediction AS threshold, count(*) AS n, sum(label) AS p FROM ratings GROUP BY user_id, prediction),
curve AS (
  SELECT user_id, threshold, sum(n) OVER w AS n_pred, sum(p) OVER w AS tp, sum(n) OVER w - sum(p) OVER w AS fp,
    sum(p) OVER (PARTITION BY user_id) AS n_pos, sum(n) OVER (PARTITION BY user_id) - sum(p) OVER (PARTITION BY user_id) AS n_neg
  FROM points WINDOW w AS (PARTITION BY user_id ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))""",
    "fmax": """
fs AS (SELECT *, round(2.0::DOUBLE * tp / (n_pred + n_pos), 9) AS f FROM curve),
fmax AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f DESC, threshold) AS k FROM fs) WHERE k = 1)""",
    "voted": """
voted AS (SELECT r.*, f.threshold AS p_th, CAST(r.prediction >= f.threshold AS INT) AS vote FROM ratings r JOIN fmax f USING (user_id))""",
    "colored": """
colored AS (
  SELECT *, sign(color)::INT AS polarity, CAST(color > 0 AS INT) AS reliable, CASE WHEN color < 0 THEN -1 ELSE color END AS reduced_color
  FROM (SELECT *, CASE WHEN label = 1 AND vote = 1 THEN 2 WHEN label = 0 AND vote = 0 THEN 1 WHEN label = 0 AND vote = 1 THEN -2 ELSE -1 END AS color FROM voted))""",
    "majority": """
tallies AS (SELECT item_id, sum(vote) AS ones, count(*) AS n, min_by(vote, user_id) AS first, max(label) AS label FROM voted GROUP BY item_id),
majority AS (SELECT item_id, label, CASE WHEN ones * 2 > n THEN 1 WHEN ones * 2 < n THEN 0 ELSE first END AS majority FROM tallies)""",
}


def with_ctes(*names: str) -> str:
    return "WITH " + ",".join(CTE[n] for n in names)
