"""What several steps read is made once, and not again from the texts by each."""

import pytest
from pyspark.sql import functions as F

from raterlake.operators import factorize, selection, topk
from raterlake.plans import growth, queries
from raterlake.plans import polarity as polarity_queries
from raterlake.plans import workload as W

SF = "/root/testdata/sf0.001"


def sources(df):
    """The files that a plan reads."""
    return " ".join(df.inputFiles())


def recorded(monkeypatch, module, name):
    """The first arguments of a function's calls, which still runs."""
    seen, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda df, *a, **more: (seen.append(df), real(df, *a, **more))[1])
    return seen


def test_forward_selection_reads_stored_ratings(spark, monkeypatch):
    seen = recorded(monkeypatch, selection.metrics, "fmax")
    assert selection.greedy_forward(W.ratings(spark, SF), 2).count() == 2
    assert len(seen) == 2 and not any("documents" in sources(df) for df in seen)


def test_grown_ensembles_read_stored_ratings(spark, monkeypatch):
    seen = recorded(monkeypatch, growth.growth, "held_out_scores")
    queries.QUERIES["grown_ensemble_scores"](spark, SF)
    assert seen and not any("documents" in sources(df) for df in seen)


def test_half_steps_read_stored_cells(spark, monkeypatch):
    seen = recorded(monkeypatch, queries.factors, "half_step")
    queries.QUERIES["als_reestimation"](spark, SF)
    assert len(seen) == 6 and not any("documents" in sources(df) for df in seen)


def test_polarity_reads_stored_cells(spark):
    assert not any("documents" in sources(df) for df in polarity_queries._split(spark, SF))


def test_gradients_from_zero(spark, monkeypatch):
    """They read stored cells, and are those that begin with factors of zero."""
    seen = recorded(monkeypatch, factorize, "cg_half_step")
    queries.QUERIES["counted_gradient_step"](spark, SF)
    assert len(seen) == 1 and "lineitem" not in sources(seen[0])
    cells = spark.createDataFrame([(u, i, 1.0 + (u * i) % 3, 2.0) for u in range(5) for i in range(7) if (u + i) % 4], "user_id int, item_id int, w double, q double")
    fixed = cells.select("item_id").distinct().select("item_id", F.array(F.col("item_id") / 7.0, F.lit(0.5)).alias("f"))
    zero = cells.select("user_id").distinct().withColumn("f", F.array(F.lit(0.0), F.lit(0.0)))
    one, two = ({r.user_id: r.f for r in factorize.cg_half_step(cells, fixed, start, "user_id", "item_id", 2, 0.1, 2).collect()} for start in (None, zero))
    assert one.keys() == two.keys() and all(one[u] == pytest.approx(two[u]) for u in one)


@pytest.mark.parametrize("name", ["cross_similarity", "transferred_factors", "transferred_confidence", "predicted_new_items"])
def test_transfers_read_stored_ratings(spark, monkeypatch, name):
    seen = recorded(monkeypatch, topk, "best_pairs")
    made = queries.QUERIES[name](spark, SF)
    assert len(seen) == 1 and "documents" not in sources(seen[0]) + sources(made)
