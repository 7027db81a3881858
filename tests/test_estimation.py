"""Model selection against models trained one by one, and re-estimation in rounds that stop and go on."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterlake.operators import cascade, factors, labels, model_selection
from raterlake.operators.state import shared_folder
from tests.test_polarity import planted

GRID = [{"rank": 1, "reg": 0.1}, {"rank": 3, "reg": 0.5}, {"rank": 2, "reg": 0.01}]


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(9)
    rows = [(u, i, int((u * 7 + i * 3) % 2), float(rng.random()), float(rng.integers(1, 3))) for u in range(8) for i in range(12) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "user_id long, item_id long, part int, target double, weight double")


def test_grid_as_single_models(spark, cells):
    scores = {(r.model, r.part): (r.rmse, r.n) for r in model_selection.dev_scores(cells, GRID, 2).collect()}
    assert len(scores) == 6
    for m, g in enumerate(GRID):
        for part in (0, 1):
            # The same initial factors: those of all cells' ids, cut to the rank.
            users = factors.initial(cells, "user_id", 3, 7).select("user_id", F.slice("f", 1, g["rank"]).alias("f"))
            train = cells.filter(F.col("part") != part)
            for _ in range(2):
                items = factors.half_step(train, users, "item_id", "user_id", g["rank"], g["reg"])
                users = factors.half_step(train, items, "user_id", "item_id", g["rank"], g["reg"])
            held = factors.predict(users, items, cells.filter(F.col("part") == part).withColumnRenamed("target", "prediction"))
            want = factors.errors(held).first()
            assert scores[m, part] == (pytest.approx(want.rmse, abs=1e-9), held.count())


def test_jobs_dont_grow_with_the_grid(spark, cells):
    def jobs(grid):
        name = str(uuid.uuid4())
        spark.sparkContext.setJobGroup(name, name)
        model_selection.dev_scores(cells, grid, 1).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    few, many = jobs(GRID[:1]), jobs([{"rank": 1 + k % 3, "reg": 0.1 * (k + 1)} for k in range(9)])
    spark.sparkContext.setJobGroup("", "")
    assert many <= few + 3


def test_choice(spark):
    rows = [(0, 1, 0.1, 0, 0.30, 5), (0, 1, 0.1, 1, 0.30, 5), (0, 1, 0.1, 2, 0.30, 5), (1, 2, 0.1, 0, 0.29, 5), (1, 2, 0.1, 1, 0.29, 5), (1, 2, 0.1, 2, 0.90, 5)]
    scores = spark.createDataFrame(rows, "model int, rank int, reg double, part int, rmse double, n long")
    assert model_selection.chosen(scores, "mean").first().model == 0 and model_selection.chosen(scores, "frequency").first().model == 1
    assert model_selection.chosen(scores.limit(0)).collect() == []


def run(spark, known, new, folder, most):
    out, n = cascade.settle(known, new, folder, most=most)
    return {r.item_id: r.label for r in out.collect()}, n


def test_rounds_settle_and_go_on(spark):
    known, _ = planted(spark, 60, 1)
    new, truth = planted(spark, 50, 2)
    new = new.drop("label", "color").withColumn("p_th", F.lit(0.5)).withColumn("item_id", F.col("item_id") + 1000)
    begun = {r.item_id: r.majority for r in labels.majority(new).collect()}
    whole, n = run(spark, known, new, f"{shared_folder(spark)}/a-{uuid.uuid4()}", 12)
    assert 1 <= n < 12 and np.mean([whole[1000 + i] == truth[i] for i in range(50)]) >= np.mean([begun[1000 + i] == truth[i] for i in range(50)]) - 0.05
    folder = f"{shared_folder(spark)}/b-{uuid.uuid4()}"
    _, first = run(spark, known, new, folder, 1)
    assert first == 1
    again, m = run(spark, known, new, folder, 12)
    assert again == whole and m == n
    # All rounds are there, the last one without a move; a finished run isn't run again.
    done = cascade.rounds(spark, folder)
    assert done.select("round").distinct().count() == n + 1 and done.filter(F.col("round") == n).filter("moved").count() == 0
    assert run(spark, known, new, folder, 12) == (whole, n)


def test_right_cells_stay(spark):
    known, _ = planted(spark, 20, 1)
    new, _ = planted(spark, 10, 2)
    new = new.withColumn("item_id", F.col("item_id") + 1000)
    out = cascade.renewed(new, known, 2, 1, 0.1, 7).collect()
    assert len(out) == 50 and all(r.renewed == r.prediction for r in out if r.color > 0) and any(r.renewed != r.prediction for r in out if r.color < 0)
    assert all(0 <= r.renewed <= 1 for r in out)
