"""Biased factors by stochastic gradient descent over blocks that don't meet.

Raters and items are dealt over B blocks each. A stratum is B blocks of cells of which no two share a rater or an item, so its blocks run at once, each with the factors of its
own raters and items, and no update is lost; B strata make an epoch (Gemulla et al., Large-scale matrix factorization with distributed stochastic gradient
descent). A rating is mean + bias of the rater + bias of the item + x . y.

B is doubled until no block holds more than ``block`` cells: a rater with a third of all cells is cut by the blocks of its items. Factors are written out
after each stratum, so a lost executor costs one stratum at most. Within a block cells are taken in the order of a hash of the epoch, so runs agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlake.functions import arrays
from raterlake.operators.state import stored

#: Cells of a block, and cells whose gradients are added up before factors move.
BLOCK, BATCH = 1 << 20, 32
#: Blocks a side at most.
MOST = 1 << 12


@dataclass
class Model:
    """mean; users: user_id, bias, f; items: item_id, bias, f; curve: (epoch, train_rmse, test_rmse or None) from epoch 0, the start."""

    mean: float
    users: DataFrame
    items: DataFrame
    curve: list[tuple[int, float, float | None]]

    def predict(self, cells: DataFrame) -> DataFrame:
        """cells with estimate; new raters and items count with no bias and no factors."""
        return predicted(cells, self.mean, self.users, self.items)


def predicted(cells: DataFrame, mean: float, users: DataFrame, items: DataFrame) -> DataFrame:
    u, i = (side.select(key, F.col("bias").alias(f"_b{k}"), F.col("f").alias(f"_f{k}")) for side, key, k in ((users, "user_id", "u"), (items, "item_id", "i")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    estimate = F.lit(mean) + zero(F.col("_bu")) + zero(F.col("_bi")) + zero(arrays.dot(F.col("_fu"), F.col("_fi")))
    return cells.join(u, "user_id", "left").join(i, "item_id", "left").withColumn("estimate", estimate).drop("_bu", "_bi", "_fu", "_fi")


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(blocks)).cast("int")


def number_of_blocks(cells: DataFrame, block: int) -> int:
    """Blocks a side such that none of their products holds more than so many cells."""
    blocks = 1
    while blocks < MOST:
        largest = cells.groupBy(_block("user_id", blocks), _block("item_id", blocks)).count().agg(F.max("count")).first()[0] or 0
        if largest <= block:
            return blocks
        blocks *= 2
    return blocks


def _begin(cells: DataFrame, key: str, rank: int, seed: int) -> DataFrame:
    """Small factors from hashes of ids, and no bias."""
    h = lambda k: (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed), F.lit(k)), F.lit(2001)) / 1000.0 - 1.0) * 0.1
    return cells.select(key).distinct().select(key, F.lit(0.0).alias("bias"), F.array(*(h(k) for k in range(rank))).alias("f"))


def descend(u: np.ndarray, i: np.ndarray, t: np.ndarray, bu: np.ndarray, bi: np.ndarray, x: np.ndarray, y: np.ndarray, mean: float, rate: float, reg: float) -> None:
    """Goes through cells (places of raters and items, targets) once, and moves biases and factors in place, BATCH cells at a time."""
    for a in range(0, len(t), BATCH):
        p, q = u[a : a + BATCH], i[a : a + BATCH]
        xp, yq = x[p], y[q]
        e = (t[a : a + BATCH] - mean - bu[p] - bi[q] - (xp * yq).sum(1))[:, None]
        np.add.at(bu, p, rate * (e[:, 0] - reg * bu[p]))
        np.add.at(bi, q, rate * (e[:, 0] - reg * bi[q]))
        np.add.at(x, p, rate * (e * yq - reg * xp))
        np.add.at(y, q, rate * (e * xp - reg * yq))


def _stratum(rows: DataFrame, mean: float, rate: float, reg: float, epoch: int, schema: str) -> DataFrame:
    def one(block: pd.DataFrame) -> pd.DataFrame:
        kinds, number = {k: g for k, g in block.groupby("kind")}, block.block.iloc[0]
        users, items, cells = (kinds.get(k, block.iloc[:0]) for k in ("user", "item", "cell"))
        if not len(cells):
            return block.loc[block.kind != "cell", ["block", "kind", "id", "bias", "f"]]
        order = pd.util.hash_array((cells.id + "|" + cells.other + f"|{epoch}").to_numpy(object)).argsort(kind="stable")
        cells = cells.iloc[order]
        place = lambda side: pd.Series(np.arange(len(side)), index=side.id)
        u, i = place(users)[cells.id].to_numpy(), place(items)[cells.other].to_numpy()
        bu, bi = users.bias.to_numpy(float, copy=True), items.bias.to_numpy(float, copy=True)
        x, y = np.stack(users.f.to_list()).copy(), np.stack(items.f.to_list()).copy()
        descend(u, i, cells.target.to_numpy(float), bu, bi, x, y, mean, rate, reg)
        return pd.concat([pd.DataFrame({"block": number, "kind": k, "id": s.id.to_numpy(), "bias": b, "f": list(f)}) for k, s, b, f in (("user", users, bu, x), ("item", items, bi, y))])

    return rows.groupBy("block").applyInPandas(one, schema)


def fit(cells: DataFrame, rank: int = 4, epochs: int = 5, rate: float = 0.02, reg: float = 0.02, seed: int = 7, test: DataFrame | None = None, block: int = BLOCK) -> Model:
    """A model of cells with user_id, item_id and target, and its errors after each epoch on them and on ``test`` cells."""
    kinds = {k: cells.schema[k].dataType.simpleString() for k in ("user_id", "item_id")}
    blocks = number_of_blocks(cells, block)
    ready = stored(cells.select("user_id", "item_id", F.col("target").cast("double").alias("target"), _block("user_id", blocks).alias("ub"), _block("item_id", blocks).alias("ib")).filter("target IS NOT NULL"))
    mean = ready.agg(F.avg("target")).first()[0] or 0.0
    rmse = lambda c, users, items: c.transform(lambda d: predicted(d, mean, users, items)).agg(F.sqrt(F.avg(F.pow(F.col("target") - F.col("estimate"), F.lit(2))))).first()[0]
    side = lambda key, kind, s: _begin(ready, key, rank, s).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), "bias", "f", _block(key, blocks).alias("b"))
    state = stored(side("user_id", "user", seed).unionByName(side("item_id", "item", seed + 1)))
    split = lambda s: tuple(s.filter(F.col("kind") == k).select(F.col("id").cast(kinds[f"{k}_id"]).alias(f"{k}_id"), "bias", "f") for k in ("user", "item"))
    curve = [(0, rmse(ready, *split(state)), rmse(test, *split(state)) if test is not None else None)]
    nothing = F.lit(None).cast("string")
    for epoch in range(1, epochs + 1):
        for stratum in range(blocks):
            # The block of raters b meets the block of items b + stratum.
            mine = ready.filter(F.pmod(F.col("ib") - F.col("ub"), F.lit(blocks)) == stratum)
            rows = mine.select(F.col("ub").alias("block"), F.lit("cell").alias("kind"), F.col("user_id").cast("string").alias("id"), F.col("item_id").cast("string").alias("other"), "target", F.lit(None).cast("double").alias("bias"), F.lit(None).cast("array<double>").alias("f"))
            at = F.when(F.col("kind") == "user", F.col("b")).otherwise(F.pmod(F.col("b") - stratum, F.lit(blocks)))
            held = state.select(at.alias("block"), "kind", "id", nothing.alias("other"), F.lit(None).cast("double").alias("target"), "bias", "f")
            moved = _stratum(rows.unionByName(held), mean, rate, reg, epoch, "block int, kind string, id string, bias double, f array<double>")
            back = F.when(F.col("kind") == "user", F.col("block")).otherwise(F.pmod(F.col("block") + stratum, F.lit(blocks)))
            state = stored(moved.select("kind", "id", "bias", "f", back.alias("b")))
        curve.append((epoch, rmse(ready, *split(state)), rmse(test, *split(state)) if test is not None else None))
    return Model(mean, *split(state), curve)
