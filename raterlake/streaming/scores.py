"""Running summaries over a stream of ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_scores(stream: DataFrame, every: str = "10 minutes", late: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """For each window and rater: n, mean score, share of right votes at 0.5. Rows later than the watermark are left out. Works on
    a stream and on a table."""
    hit = ((F.col("prediction") >= 0.5).cast("int") == F.col("label")).cast("int")
    rows = stream.withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, every).alias("w"), "user_id").agg(F.count("*").alias("n"), F.avg("prediction").alias("mean"), F.avg(hit).alias("right"))
    return out.select(F.col("w.start").alias("start"), "user_id", "n", "mean", "right")


def first_ratings(stream: DataFrame, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Each (user_id, item_id) once within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(["user_id", "item_id"])
