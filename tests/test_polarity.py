"""Polarity without labels, features of rows of raters, and numbering, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raterlake.functions import scalar
from raterlake.operators import polarity, sequences
from raterlake.operators.numbering import numbered

SCHEMA = "user_id string, item_id long, prediction double, label int, vote int, color int"


def planted(spark, n, seed, good=0.8):
    """Cells of raters whose scores lie high for positive items with different sharpness, and one that tells nothing."""
    rng = np.random.default_rng(seed)
    label = (rng.random(n) < 0.4).astype(int)
    rows = []
    for u, pull in {"a": 0.9, "b": 0.7, "c": good, "d": 0.5, "e": 0.0}.items():
        p = np.clip(0.5 + pull * (label - 0.5) * 0.6 + rng.normal(0, 0.18, n), 0, 1).round(3)
        vote = (p >= 0.5).astype(int)
        color = np.where(label == vote, np.where(label == 1, 2, 1), np.where(label == 1, -1, -2))
        rows += [(u, int(i), float(p[i]), int(label[i]), int(vote[i]), int(color[i])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), label


def brute_support(group, k_upper, k_lower, k_min):
    """Polarity of one item's cells: dicts user -> answer, by the rule in words."""
    sign = 1 if group[0]["positive"] else -1
    v = {c["user_id"]: sign * c["prediction"] for c in group}
    m = {c["user_id"]: c["if_positive"] if c["positive"] else c["if_negative"] for c in group}
    high, low = sorted(v, key=lambda u: (-v[u], u)), sorted(v, key=lambda u: (v[u], u))
    right, wrong = [u for u in high if m[u] == 1][:k_upper], [u for u in low if m[u] == -1][:k_lower]
    if not right and wrong:
        right = [u for u in high if v[u] > np.median([v[w] for w in wrong])][: max(k_min, len(wrong))]
    elif right and not wrong:
        wrong = [u for u in low if v[u] < np.median([v[w] for w in right])][: max(k_min, len(right))]
    if not right or not wrong:
        right, wrong = high[:k_min], low[:k_min]
    return {u: -1 if u in wrong else 1 if u in right else 0 for u in v}


@pytest.mark.parametrize("limits", [(3, 3, 1), (1, 2, 2), (5, 5, 1)])
def test_supported_cells(spark, limits):
    rng = np.random.default_rng(5)
    cells = [{"user_id": f"u{u}", "item_id": i, "prediction": float(rng.integers(0, 8) / 8), "if_positive": int(rng.integers(-1, 2)) if i % 4 else int(i % 8 == 0), "if_negative": int(rng.integers(-1, 2)) if i % 3 else 0, "positive": i % 2} for i in range(60) for u in range(1 + i % 6)]
    df = spark.createDataFrame(pd.DataFrame(cells))
    out = polarity.supported(df.drop("positive"), df.select("item_id", "positive").distinct(), *limits).collect()
    want = {(i, u): c for i in range(60) for u, c in brute_support([x for x in cells if x["item_id"] == i], *limits).items()}
    assert {(r.item_id, r.user_id): r.polarity for r in out} == want


def brute_loop(cells, known, bins=polarity.BINS, moves=2):
    """The loop over densities, in plain pandas, from the labels that votes give."""
    b = lambda d: np.clip((d.prediction * bins).astype(int), 0, bins - 1)
    p1, p0 = known[known.label == 1].vote.mean(), known[known.label == 0].vote.mean()
    prior = known.groupby("item_id").label.max().mean()
    t = cells.groupby("item_id").vote.agg(["sum", "count"])
    odds = t["sum"] * np.log(p1 / p0) + (t["count"] - t["sum"]) * np.log((1 - p1) / (1 - p0)) + np.log(prior / (1 - prior))
    label, moved = (odds >= 0).astype(int), pd.Series(0, t.index)
    for turn in range(1, 51):
        own = cells.assign(label=cells.item_id.map(label))
        own["color"] = np.where(own.label == own.vote, np.where(own.label == 1, 2, 1), np.where(own.label == 1, -1, -2))
        both = pd.concat([known[["user_id", "prediction", "color"]], own[["user_id", "prediction", "color"]]])
        share = {}
        for u, mine in both.groupby("user_id"):
            for name, color in polarity.COLORS.items():
                h = np.bincount(b(mine[mine.color == color]), minlength=bins).astype(float)
                near = 2 * h + np.append(h[1:], 0) + np.append(0, h[:-1])
                share[u, name] = h.sum() * (near + 1) / (4 * h.sum() + bins)
        at = lambda name: np.array([share[u, name][k] for u, k in zip(cells.user_id, b(cells), strict=True)])  # noqa: E731, B023
        lean = pd.Series(np.sign(at("tp") - at("fn")) - np.sign(at("tn") - at("fp"))).groupby(cells.item_id.to_numpy()).sum()
        new = label.where((moved >= moves) | (lean == 0), (lean > 0).astype(int))
        changed = new != label
        label, moved = new, moved + changed
        if not changed.any():
            return label, turn
    return label, 50


def test_labels_settle(spark):
    known, _ = planted(spark, 150, 1)
    cells, label = planted(spark, 300, 2)
    got, rounds = polarity.settled_labels(cells.drop("label", "color"), known)
    want, turns = brute_loop(cells.drop("label", "color").toPandas(), known.toPandas())
    got = {r.item_id: r.label for r in got.collect()}
    assert got == want.to_dict() and rounds == turns < 50
    assert np.mean([got[i] == label[i] for i in got]) > 0.9


@pytest.mark.parametrize("policy", polarity.POLICIES)
def test_policies_settle(spark, policy):
    known, _ = planted(spark, 60, 3)
    cells, label = planted(spark, 60, 4)
    got, rounds = polarity.settled_labels(cells.drop("label", "color"), known, policy)
    got = {r.item_id: r.label for r in got.collect()}
    assert rounds < 50 and len(got) == 60
    # An interval that overlaps says little, but the others agree with the planted labels.
    assert policy == "interval" or np.mean([got[i] == label[i] for i in got]) > 0.8


def test_unknown_raters_are_undecided(spark):
    known, _ = planted(spark, 20, 1)
    cells = spark.createDataFrame([("new", 1, 0.7, 1), ("a", 1, 0.9, 1)], "user_id string, item_id long, prediction double, vote int")
    for policy in polarity.POLICIES:
        out = {r.user_id: (r.if_positive, r.if_negative) for r in polarity.hypotheses(cells, known, policy).collect()}
        assert out["new"] == (0, 0)
        assert {r.user_id for r in polarity.hypotheses(cells, known.limit(0), policy).collect()} == {"new", "a"}


def test_synthetic_items(spark):
    known, _ = planted(spark, 80, 6)
    for label, fitting in ((1, {2, -1}), (0, {1, -2})):
        out = polarity.synthetic_items(known, 400, label).collect()
        mine = {}
        for r in known.collect():
            if r.color in fitting:
                mine.setdefault(r.user_id, set()).add((r.prediction, r.color))
        assert len(out) == 400 * len(mine) == len({(r.item_id, r.user_id) for r in out})
        assert all((r.prediction, r.color) in mine[r.user_id] and r.label == label and r.item_id < 0 for r in out)
        # With replacement, 400 draws meet nearly all of a rater's few dozen cells.
        for u, cells in mine.items():
            assert len({(r.prediction, r.color) for r in out if r.user_id == u}) > 0.9 * len(cells)
    assert polarity.synthetic_items(known, 3).exceptAll(polarity.synthetic_items(known.repartition(7), 3)).count() == 0


def test_neighbourhoods_by_brute_force(spark):
    """Kolmogorov-Smirnov distances, skews and kurtoses over plain lists of slots."""
    known, _ = planted(spark, 120, 7)
    rows = known.toPandas()
    rows["slot"] = np.clip((rows.prediction * sequences.SLOTS).astype(int), 0, sequences.SLOTS - 1)
    got = {(r.user_id, r.bin): r for r in sequences.neighbourhoods(sequences.grid(known)).collect()}
    seen = 0
    for u, mine in rows.groupby("user_id"):
        for k in range(32):
            near = mine[(mine.slot >= 32 * (k - 2)) & (mine.slot < 32 * (k + 3))]
            assert ((u, k) in got) == (len(near) > 0)
            if not len(near):
                continue
            every = near.slot.to_numpy()
            spread = lambda x: np.sqrt(((x - x.mean()) ** 2).mean())
            for name, color in polarity.COLORS.items():
                own = near[near.color == color].slot.to_numpy()
                r = got[u, k]
                ks = max((abs((every <= s).mean() - (own <= s).mean()) for s in np.unique(every)), default=0) if len(own) else 0
                assert r[f"ks_{name}"] == pytest.approx(ks)
                want = {"sd": 0, "skew": 0, "kurtosis": 0}
                if len(own) and own.std():
                    d = own - own.mean()
                    shape = lambda x, p: ((x - x.mean()) ** p).mean() / spread(x) ** p if spread(x) else 0
                    want = {"sd": spread(own) / 1024 / (spread(every) / 1024 + 1e-4), "skew": shape(own, 3) / (shape(every, 3) + 1e-4), "kurtosis": (shape(own, 4) - 3) / (shape(every, 4) - 3 + 1e-4)}
                    assert len(d)
                    seen += 1
                for s, x in want.items():
                    assert r[f"{s}_{name}"] == pytest.approx(x, rel=1e-5, abs=1e-6), (s, name)
    assert seen > 100


def test_features_of_odd_cells(spark):
    known, _ = planted(spark, 30, 8)
    cells = spark.createDataFrame([("a", 1, 0.5, 1), ("b", 1, 0.5, 0), ("x", 1, 1.0, 1), ("a", 2, 0.0, 0)], "user_id string, item_id long, prediction double, vote int")
    out = {(r.item_id, r.user_id): r for r in sequences.features(cells, known).collect()}
    assert len(out) == 4 and [out[1, u].v_rank for u in "abx"] == [0.5, 0.5, 1.0]
    assert out[1, "b"].value_1 == 0.5 and out[1, "b"].value_m1 == 1.0 and out[1, "b"].vote_2 is None and out[1, "x"].vote_2 == 1 and out[1, "a"].first == 1
    assert out[1, "x"].tail_tptn == 0 and out[1, "x"].ks_tpfp == 0 and out[2, "a"].value_1 is None
    assert len(sequences.features(cells, known.limit(0)).collect()) == 4 and sequences.features(cells.limit(0), known).collect() == []


def test_numbers_within_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'rare', 'hot') as k", "id")
    out = numbered(rows, ["k"], ["id"], total="of").toPandas()
    for _, g in out.groupby("k"):
        assert sorted(g.number) == list(range(len(g))) and set(g.of) == {len(g)}
    again = numbered(rows.repartition(9), ["k"], ["id"]).toPandas()
    assert out.set_index("id").number.sort_index().tolist() == again.set_index("id").number.sort_index().tolist()


def test_colors_of_guessed_labels(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "label int, vote int")
    assert [r.c for r in df.select(scalar.color(F.col("label"), F.col("vote")).alias("c")).collect()] == [2, -1, -2, 1]
