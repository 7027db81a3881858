"""Queries of model selection and of re-estimation in rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from raterlake.operators import cascade, model_selection
from raterlake.operators.state import shared_folder
from raterlake.plans import workload as W
from raterlake.plans.queries import query

#: Parameters that are tried.
GRID = [{"rank": r, "reg": g} for r in (1, 2, 3) for g in (0.01, 0.3)]


def _scores(spark, sf_dir):
    part = F.pmod(F.xxhash64("user_id", "item_id"), F.lit(3)).cast("int")
    cells = W.ratings(spark, sf_dir).select("user_id", "item_id", part.alias("part"), F.col("prediction").alias("target"), F.lit(1.0).alias("weight"))
    return model_selection.dev_scores(cells, GRID, iterations=1)


@query()
def grid_scores(spark, sf_dir):
    """Errors of each choice of parameters on each part of all ratings."""
    return _scores(spark, sf_dir)


@query()
def chosen_model(spark, sf_dir):
    return model_selection.chosen(_scores(spark, sf_dir), "frequency")


@query()
def reestimated_labels(spark, sf_dir):
    """Labels of fold 0 after rounds of re-estimation with the other folds, and the number of rounds."""
    cells = W.colored(spark, sf_dir)
    labels, n = cascade.settle(cells.filter("fold <> 0"), cells.filter("fold = 0"), f"{shared_folder(spark)}/rounds-{uuid.uuid4()}", most=4)
    return labels.withColumn("rounds", F.lit(n))
