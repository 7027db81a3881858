"""Queries of polarity without labels and of features of rows of raters. Cells of fold 0 are judged by those of the other folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from raterlake.operators import factors, polarity, reshape, sequences
from raterlake.operators.state import stored
from raterlake.plans import workload as W
from raterlake.plans.queries import _C, query
from raterlake.plans.workload import with_ctes


def _split(spark, sf_dir):
    cells = stored(W.colored(spark, sf_dir))
    return cells.filter("fold = 0").select("user_id", "item_id", "prediction", "vote"), cells.filter("fold <> 0")


_SPLIT = with_ctes(*_C) + """, known AS (SELECT * FROM colored WHERE fold <> 0), cells AS (SELECT user_id, item_id, prediction, vote FROM colored WHERE fold = 0)"""
_NAMES = {"tp": 2, "tn": 1, "fp": -2, "fn": -1}


def _answers(up: str, down: str) -> str:
    """SQL of the answers by one statistic for upper bounds and one for lower ones."""
    of = lambda s, c: f"round({s}(prediction) FILTER (color = {_NAMES[c]}), 9)"
    s = f"s AS (SELECT user_id, {of(up, 'tp')} AS tp, {of(up, 'fp')} AS fp, {of(down, 'tn')} AS tn, {of(down, 'fn')} AS fn FROM known GROUP BY user_id)"
    yes = lambda x: f"coalesce({x}, false)::INT"
    pair = f"{yes('prediction >= tp')} - {yes('prediction <= fn')} AS if_positive, {yes('prediction <= tn')} - {yes('prediction >= fp')} AS if_negative"
    return f", {s}, answers AS (SELECT c.*, {pair} FROM cells c LEFT JOIN s USING (user_id))"


_BINS = """, h AS (SELECT user_id, color, greatest(least(floor(prediction * 32), 31), 0)::INT AS bin, count(*) AS n FROM known GROUP BY ALL),
totals AS (SELECT user_id, color, sum(n)::DOUBLE AS n FROM h GROUP BY ALL),
spread AS (SELECT user_id, color, bin + o AS bin, sum(n * (2 - abs(o)))::DOUBLE AS k FROM h, (SELECT unnest([-1, 0, 1]) AS o) GROUP BY ALL),
d AS (SELECT t.user_id, t.color, b.bin, n * (coalesce(k, 0) + 1.0::DOUBLE) / (4.0::DOUBLE * n + 32) AS share
  FROM totals t CROSS JOIN (SELECT range::INT AS bin FROM range(32)) b LEFT JOIN spread s ON s.user_id = t.user_id AND s.color = t.color AND s.bin = b.bin),
shares AS (SELECT user_id, bin, coalesce(max(share) FILTER (color = 2), 0) AS tp, coalesce(max(share) FILTER (color = 1), 0) AS tn,
  coalesce(max(share) FILTER (color = -2), 0) AS fp, coalesce(max(share) FILTER (color = -1), 0) AS fn FROM d GROUP BY ALL),
answers AS (SELECT c.*, coalesce(sign(tp - fn), 0)::INT AS if_positive, coalesce(sign(tn - fp), 0)::INT AS if_negative
  FROM cells c LEFT JOIN shares s ON s.user_id = c.user_id AND s.bin = greatest(least(floor(c.prediction * 32), 31), 0)::INT)"""

_ODDS = """, rates AS (SELECT avg(vote) FILTER (label = 1) AS p1, avg(vote) FILTER (label = 0) AS p0, (SELECT avg(label) FROM (SELECT item_id, max(label) AS label FROM known GROUP BY 1)) AS prior FROM known),
safe AS (SELECT greatest(least(p1, 1 - 1e-6), 1e-6) AS p1, greatest(least(p0, 1 - 1e-6), 1e-6) AS p0, greatest(least(prior, 1 - 1e-6), 1e-6) AS prior FROM rates),
odds AS (SELECT item_id, round(sum(vote) * ln(p1 / p0) + (count(*) - sum(vote)) * ln((1 - p1) / (1 - p0)) + ln(prior / (1 - prior)), 9) AS log_odds FROM cells, safe GROUP BY item_id, p1, p0, prior)"""

_SUPPORT = """, m AS (SELECT a.*, CASE WHEN log_odds >= 0 THEN 1 ELSE 0 END AS positive, CASE WHEN log_odds >= 0 THEN if_positive ELSE if_negative END AS m,
  CASE WHEN log_odds >= 0 THEN prediction ELSE -prediction END AS v FROM answers a JOIN odds USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, m ORDER BY v DESC, user_id) AS high_m, row_number() OVER (PARTITION BY item_id, m ORDER BY v, user_id) AS low_m,
  row_number() OVER (PARTITION BY item_id ORDER BY v DESC, user_id) AS high, row_number() OVER (PARTITION BY item_id ORDER BY v, user_id) AS low FROM m),
c AS (SELECT *, CASE WHEN m = 1 AND high_m <= 3 THEN 1 WHEN m = -1 AND low_m <= 3 THEN -1 ELSE 0 END AS c FROM r),
i AS (SELECT item_id, count(*) FILTER (c = 1) AS n_right, count(*) FILTER (c = -1) AS n_wrong, median(v) FILTER (c = 1) AS mid_right, median(v) FILTER (c = -1) AS mid_wrong FROM c GROUP BY 1),
f AS (SELECT c.*, c = 1 OR (n_right = 0 AND n_wrong > 0 AND v > mid_wrong AND high <= greatest(1, n_wrong)) AS is_right,
  c = -1 OR (n_wrong = 0 AND n_right > 0 AND v < mid_right AND low <= greatest(1, n_right)) AS is_wrong FROM c JOIN i USING (item_id)),
g AS (SELECT item_id, bool_or(is_right) AND bool_or(is_wrong) AS both_found FROM f GROUP BY 1),
final AS (SELECT user_id, item_id, if_positive, if_negative, positive, CASE WHEN both_found AND is_wrong THEN -1 WHEN both_found AND is_right THEN 1 WHEN both_found THEN 0
  WHEN low <= 1 THEN -1 WHEN high <= 1 THEN 1 ELSE 0 END AS polarity FROM f JOIN g USING (item_id))"""
_RESULT = " SELECT user_id, item_id, if_positive, if_negative, positive, polarity::INT AS polarity FROM final"
_COLUMNS = ("user_id", "item_id", "if_positive", "if_negative", "positive", "polarity")


def _polarity(policy):
    def run(spark, sf_dir):
        return polarity.by_votes(*_split(spark, sf_dir), policy).select(*_COLUMNS)

    run.__name__ = f"polarity_by_{policy}"
    return run


for _policy, _sql in {"mean": _answers("avg", "avg"), "median": _answers("median", "median"), "interval": _answers("min", "max"), "density": _BINS}.items():
    query(_SPLIT + _sql + _ODDS + _SUPPORT + _RESULT)(_polarity(_policy))


@query()
def polarity_by_stacker(spark, sf_dir):
    """The same by medians, with labels from a logistic regression over the raters of the other folds."""
    cells, known = _split(spark, sf_dir)
    wide = lambda c: reshape.to_wide(c, W.USERS)
    scores = factors.stack(wide(known), wide(W.ratings(spark, sf_dir).filter("fold = 0")), W.USERS)
    return polarity.by_scores(cells, known, scores.withColumnRenamed("stacked", "score")).select(*_COLUMNS)


@query()
def settled_labels(spark, sf_dir):
    """Labels of fold 0 once they stop moving, and the rounds it took."""
    labels, rounds = polarity.settled_labels(*_split(spark, sf_dir))
    return labels.withColumn("rounds", F.lit(rounds))


@query()
def synthetic_items(spark, sf_dir):
    """As many new positive items as there are in the other folds."""
    _, known = _split(spark, sf_dir)
    n = known.filter("label = 1").select("item_id").distinct().count()
    return polarity.synthetic_items(known, n)


_FEATURES = _SPLIT + """, g AS (SELECT user_id, greatest(least(floor(prediction * 1024), 1023), 0)::INT AS slot, count(*) AS "all", count(*) FILTER (color = 2) AS tp, count(*) FILTER (color = 1) AS tn,
  count(*) FILTER (color = -2) AS fp, count(*) FILTER (color = -1) AS fn FROM known GROUP BY ALL),
e AS (SELECT u.user_id, s.range::INT AS slot, coalesce("all", 0) AS "all", coalesce(tp, 0) AS tp, coalesce(tn, 0) AS tn, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn
  FROM (SELECT DISTINCT user_id FROM g) u CROSS JOIN range(1024) s LEFT JOIN g ON g.user_id = u.user_id AND g.slot = s.range),
t AS (SELECT user_id, slot, coalesce(sum("all") OVER u, 0)::DOUBLE / sum("all") OVER w AS h_rank""" + "".join(f""",
  coalesce(1 - coalesce(sum({c}) OVER u, 0)::DOUBLE / nullif(sum({c}) OVER w, 0), 0) AS tail_{c}""" for c in _NAMES) + """
  FROM e WINDOW w AS (PARTITION BY user_id), u AS (PARTITION BY user_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT g.*, b.range::INT AS bin, slot - b.range * 32 - 16 AS x FROM g JOIN range(32) b ON b.range BETWEEN slot // 32 - 2 AND slot // 32 + 2),
k AS (SELECT user_id, bin""" + "".join(f", coalesce(max(abs(a - {c})), 0) AS ks_{c}" for c in _NAMES) + """ FROM (
  SELECT user_id, bin, sum("all") OVER u / sum("all") OVER w::DOUBLE AS a""" + "".join(f", sum({c}) OVER u / nullif(sum({c}) OVER w, 0)::DOUBLE AS {c}" for c in _NAMES) + """
  FROM n WINDOW w AS (PARTITION BY user_id, bin), u AS (PARTITION BY user_id, bin ORDER BY slot)) GROUP BY ALL),
p AS (SELECT user_id, bin, kind, m, s2 - m * m AS m2, s3 - 3 * m * s2 + 2 * m ** 3 AS m3, s4 - 4 * m * s3 + 6 * m * m * s2 - 3 * m ** 4 AS m4 FROM (
  SELECT user_id, bin, kind, sum(c * x)::DOUBLE / sum(c) AS m, sum(c * x * x)::DOUBLE / sum(c) AS s2, sum(c * x ** 3)::DOUBLE / sum(c) AS s3, sum(c * x ** 4)::DOUBLE / sum(c) AS s4
  FROM (UNPIVOT n ON "all", tp, tn, fp, fn INTO NAME kind VALUE c) WHERE c > 0 GROUP BY ALL)),
s AS (SELECT user_id, bin, kind, sqrt(m2) / 1024 AS sd, m3 / (m2 * sqrt(m2)) AS skew, m4 / (m2 * m2) - 3 AS kurtosis FROM p WHERE m2 > 1e-9),
o AS (SELECT k.user_id, k.bin, """ + ", ".join(f"ks_{c}" for c in _NAMES) + "".join(f""",
  coalesce(max({f}) FILTER (kind = '{c}') / (coalesce(max({f}) FILTER (kind = 'all'), 0) + 1e-4::DOUBLE), 0) AS {f}_{c}""" for f in ("sd", "skew", "kurtosis") for c in _NAMES) + """
  FROM k LEFT JOIN s USING (user_id, bin) GROUP BY ALL),
v AS (SELECT c.user_id, c.item_id, prediction AS value, vote, coalesce(tail_tp - tail_tn, 0) AS tail_tptn, coalesce(tail_fp - tail_fn, 0) AS tail_fpfn""" + "".join(f", coalesce({f}_{a} - {f}_{b}, 0) AS {f}_{a}{b}" for f in ("ks", "sd", "skew", "kurtosis") for a, b in (("tp", "fp"), ("tn", "fn"))) + """,
  coalesce(h_rank, 0) AS h_rank, (rank() OVER (PARTITION BY c.item_id ORDER BY prediction) + (count(*) OVER (PARTITION BY c.item_id, prediction) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY c.item_id) AS v_rank
  FROM (SELECT *, greatest(least(floor(prediction * 1024), 1023), 0)::INT AS slot FROM cells) c
  LEFT JOIN t ON t.user_id = c.user_id AND t.slot = c.slot LEFT JOIN o ON o.user_id = c.user_id AND o.bin = c.slot // 32),
l AS (SELECT *, (round(tail_tptn, 12) >= 0)::INT AS leans FROM v)
SELECT * EXCLUDE (leans) REPLACE (""" + ", ".join(f"round({c}, 6) AS {c}" for c in ("tail_tptn", "tail_fpfn", *(f"{f}_{x}" for f in ("ks", "sd", "skew", "kurtosis") for x in ("tpfp", "tnfn")), "h_rank", "v_rank")) + """), (row_number() OVER i = 1)::INT AS first""" + "".join(f", lag({c}, {k}) OVER i AS {c}_{'m' if k < 0 else ''}{abs(k)}" for k in (1, 2, -1, -2) for c in ("value", "vote", "leans")) + """
FROM l WINDOW i AS (PARTITION BY item_id ORDER BY user_id)"""


@query(_FEATURES, digits=6)
def sequence_features(spark, sf_dir):
    """Features of the cells of fold 0 in the order of their items' raters."""
    return sequences.features(*_split(spark, sf_dir))
