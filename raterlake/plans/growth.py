"""Queries of ensembles that grow step by step: for each fold the members chosen on all other folds, and the fold's scores by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from raterlake.operators import growth
from raterlake.operators.state import stored
from raterlake.plans import workload as W
from raterlake.plans.ensembles import _auc
from raterlake.plans.queries import _R, query
from raterlake.plans.workload import with_ctes

#: Members taken by their own scores, and all members.
_INITIAL, _SIZE = 2, 4
_GROWN = ("forward", "drep", "sdi")

_TRAIN = (
    with_ctes(*_R)
    + f""", t AS MATERIALIZED (SELECT model, user_id, item_id, prediction, label FROM ratings JOIN (SELECT DISTINCT fold AS model FROM ratings) ON fold <> model),
own AS MATERIALIZED (SELECT model, user_id, auc AS score FROM {_auc("t", "model, user_id", "prediction")}),
sums AS (SELECT a.model, a.user_id AS a, b.user_id AS b, count(*) AS n, sum(a.prediction) AS x, sum(b.prediction) AS y, sum(a.prediction ** 2) AS xx, sum(b.prediction ** 2) AS yy,
  sum(a.prediction * b.prediction) AS xy FROM t a JOIN t b USING (model, item_id) WHERE a.user_id <> b.user_id GROUP BY ALL),
alike AS MATERIALIZED (SELECT model, a, b, round(coalesce(CASE WHEN n * xx - x * x > 1e-9 * n * xx AND n * yy - y * y > 1e-9 * n * yy
  THEN least(abs(n * xy - x * y) / (sqrt(n * xx - x * x) * sqrt(n * yy - y * y)), 1) END, 0), 6) AS rho FROM sums),
e{_INITIAL} AS (SELECT model, step, user_id FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, user_id)::INT AS step FROM own) WHERE step <= {_INITIAL})"""
)


def _step(policy: str, k: int) -> str:
    """SQL that adds a member to ensembles of k."""
    old, p = (f"{policy}{k}" if k > _INITIAL else f"e{k}"), f"{policy}_{k}"
    text = f""", {p}_c AS MATERIALIZED (SELECT o.model, o.user_id, o.score, round((coalesce((SELECT sum(rho) / 2 FROM alike x WHERE x.model = o.model AND x.a IN (SELECT user_id FROM {old} z WHERE z.model = o.model)
    AND x.b IN (SELECT user_id FROM {old} z WHERE z.model = o.model)), 0) + (SELECT sum(rho) FROM alike x WHERE x.model = o.model AND x.b = o.user_id AND x.a IN (SELECT user_id FROM {old} z WHERE z.model = o.model)))
    / {k * (k + 1) / 2}::DOUBLE, 9) AS diversity FROM own o WHERE NOT EXISTS (SELECT 1 FROM {old} z WHERE z.model = o.model AND z.user_id = o.user_id))"""
    if policy == "sdi":
        best, order = f"{p}_c", "round(0.5::DOUBLE * score + 0.5::DOUBLE * (1 - diversity), 9) DESC, user_id"
    else:
        least = 3 if policy == "drep" else 1000
        text += f""", {p}_s AS (SELECT model, user_id FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY diversity, user_id) AS i FROM {p}_c) WHERE i <= {least}),
{p}_m AS (SELECT model, item_id, sum(prediction) AS s FROM t JOIN {old} USING (model, user_id) GROUP BY ALL),
{p}_x AS (SELECT model, user_id, label, round((s + prediction) / {k + 1}, 9) AS mixed FROM t JOIN {p}_s USING (model, user_id) JOIN {p}_m USING (model, item_id)),
{p}_a AS MATERIALIZED (SELECT model, user_id, score FROM {_auc(f"{p}_x", "model, user_id", "mixed", "score")})"""
        best, order = f"{p}_a", "score DESC, user_id"
    return text + f""", {policy}{k + 1} AS MATERIALIZED (SELECT model, step, user_id FROM {old} UNION ALL
SELECT model, {k + 1}, user_id FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {order}) AS i FROM {best}) WHERE i = 1)"""


def _steps(*policies: str) -> str:
    return _TRAIN + "".join(_step(p, k) for p in policies for k in range(_INITIAL, _SIZE))


@query(
    _steps(*_GROWN)
    + f""", g AS MATERIALIZED ({" UNION ALL ".join(f"SELECT '{p}' AS policy, * FROM {p}{_SIZE}" for p in _GROWN)}),
sizes AS (SELECT unnest(range(1, {_SIZE + 1}))::INT AS size),
means AS (SELECT policy, model, size, item_id, max(label) AS label, round(avg(prediction), 9) AS prediction FROM g JOIN sizes ON step <= size JOIN t USING (model, user_id) GROUP BY ALL),
scores AS (SELECT policy, model, size AS step, score FROM {_auc("means", "policy, model, size", "prediction", "score")}),
d AS (SELECT policy, model, size AS step, round(avg(rho), 9) AS diversity FROM sizes JOIN g x ON x.step <= size JOIN g y USING (policy, model) JOIN alike USING (model) WHERE y.step <= size AND x.step < y.step AND a = x.user_id AND b = y.user_id GROUP BY ALL)
SELECT policy, model, step, user_id, score, diversity FROM g JOIN scores USING (policy, model, step) LEFT JOIN d USING (policy, model, step)""",
    digits=9,
)
def grown_ensembles(spark, sf_dir):
    """Members by three policies in their order, with the score and the likeness of the ensemble up to each."""
    r = stored(W.ratings(spark, sf_dir))
    each = [growth.growth_curve(r, growth.grown(r, p, _INITIAL, _SIZE, least=3)).withColumn("policy", F.lit(p)) for p in _GROWN]
    return reduce(lambda a, b: a.unionByName(b), each)


@query(
    _steps("forward")
    + f""", sizes AS (SELECT unnest(range(1, {_SIZE + 1}))::INT AS size),
means AS (SELECT model, size, item_id, max(label) AS label, round(avg(prediction), 9) AS prediction FROM forward{_SIZE} JOIN sizes ON step <= size JOIN t USING (model, user_id) GROUP BY ALL),
best AS (SELECT model, size FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, size) AS i FROM {_auc("means", "model, size", "prediction", "score")}) WHERE i = 1)
SELECT fold, item_id, max(label) AS label, round(avg(prediction), 9) AS prediction, max(size) AS size FROM ratings r JOIN forward{_SIZE} f ON f.model = r.fold AND f.user_id = r.user_id
JOIN best b ON b.model = r.fold AND f.step <= b.size GROUP BY ALL""",
    digits=9,
)
def grown_ensemble_scores(spark, sf_dir):
    """Each fold's items by the mean of the members chosen on the other folds."""
    r = stored(W.ratings(spark, sf_dir))
    return growth.held_out_scores(r, growth.grown(r, "forward", _INITIAL, _SIZE))
