"""Scores of new items estimated again and again, with labels from the round before, until the labels settle.

A round colours the new items' cells by their present labels, trains factors on all right cells of known and new items, puts the factors' estimates in place of the new
items' wrong cells, and lets the raters vote anew. Each round's labels are a table of their own under one folder, so a run that was stopped goes on from the last
round that was finished, and gives what it would have given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from raterlake.operators import factors, labels
from raterlake.operators.state import stored


def rounds(spark, folder: str) -> DataFrame | None:
    """item_id, label, moves, moved and round of all finished rounds; None before the first."""
    try:
        done = spark.read.parquet(folder)
    except AnalysisException:
        return None
    return done if "round" in done.columns else None


def _write(df: DataFrame, folder: str, number: int) -> None:
    # A round that was cut short left no rows; its folder is written anew.
    df.write.mode("overwrite").parquet(f"{folder}/round={number}")


def renewed(cells: DataFrame, known: DataFrame, rank: int, iterations: int, reg: float, seed: int) -> DataFrame:
    """cells (with label and color) with renewed: wrong cells take the estimate of factors trained on the right cells of these and the known ones."""
    need = ["user_id", "item_id", "prediction", "color"]
    right = known.select(*need).unionByName(cells.select(*need)).filter("color > 0").select("user_id", "item_id", F.col("prediction").alias("target"), F.lit(1.0).alias("weight"))
    users, items = factors.als(stored(right), rank, iterations, reg, seed)
    u, i = users.withColumnRenamed("f", "_u"), items.withColumnRenamed("f", "_i")
    # Items without any right cell have no factors, and keep their scores.
    joined = cells.join(u, "user_id", "left").join(i, "item_id", "left")
    estimate = F.coalesce(factors.arrays.dot(F.col("_u"), F.col("_i")), F.col("prediction"))
    return factors.reestimate(joined.withColumn("_e", estimate), "_e").drop("_u", "_i", "_e")


def settle(known: DataFrame, new: DataFrame, folder: str, rank: int = 2, iterations: int = 2, reg: float = 0.1, moves: int = 2, most: int = 20, seed: int = 7) -> tuple[DataFrame, int]:
    """item_id, label of the new items (cells with user_id, item_id, prediction, p_th, vote), and the number of rounds until no label moved (``most`` at the latest).
    known: coloured cells. An item that has moved ``moves`` times stays. folder: of one run; what it holds is gone on from."""
    spark = known.sparkSession
    known = stored(known.select("user_id", "item_id", "prediction", "color"))
    new = stored(new.select("user_id", "item_id", "prediction", "p_th", "vote"))
    done = rounds(spark, folder)
    last = done.agg(F.max("round")).first()[0] if done is not None else None
    if last is None:
        last = 0
        _write(labels.majority(new).select("item_id", F.col("majority").alias("label"), F.lit(0).alias("moves"), F.lit(True).alias("moved")), folder, 0)
    now = lambda k: spark.read.parquet(f"{folder}/round={k}")
    while last < most and now(last).filter("moved").count():
        cells = labels.colored(new.join(now(last).select("item_id", "label", "moves"), "item_id"))
        again = renewed(cells, known, rank, iterations, reg, seed).withColumn("vote", (F.col("renewed") >= F.col("p_th")).cast("int"))
        voted = labels.majority(again.select("user_id", "item_id", "vote"))
        both = now(last).drop("moved").join(voted, "item_id")
        label = F.when(F.col("moves") >= moves, F.col("label")).otherwise(F.col("majority"))
        moved = label != F.col("label")
        _write(both.select("item_id", label.alias("label"), (F.col("moves") + moved.cast("int")).alias("moves"), moved.alias("moved")), folder, last + 1)
        last += 1
    return now(last).select("item_id", "label"), last
