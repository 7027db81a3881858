"""Factors kept as a table of versions, new raters and items folded in, and least squares by conjugate gradients.

A side's factors solve (G + sum w f f' + reg I) x = sum q f over the other side's factors f, one system for each id: weights w and coefficients q come with the cells
(explicit ratings: q = w target and G = 0; counts: w = c - 1, q = c, and G the gram matrix of all fixed factors, as cells that aren't there count once).
Conjugate gradients need only products of the matrix with one vector for each id, which are sums over cells with map-side partial sums: ``rank`` numbers an id, no matrix, and an id
with a third of all cells is as easy as any other. All of it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlake.functions import arrays
from raterlake.operators import factors
from raterlake.operators.state import stored


# Versions of factors.


def save_factors(folder: str, users: DataFrame, items: DataFrame, version: int = 0) -> None:
    """Writes (user_id, f) and (item_id, f) as one version. A version that is there already isn't changed."""
    side = lambda df, name: df.select(F.lit(name).alias("side"), F.col(f"{name}_id").cast("string").alias("id"), "f")
    side(users, "user").unionByName(side(items, "item")).write.parquet(f"{folder}/version={version}")


def load_factors(spark: SparkSession, folder: str, side: str, version: int | None = None, id_type: str = "string") -> DataFrame:
    """user_id or item_id and f of one side ("user" or "item") as of a version: of each id the factors last written; the newest version by default."""
    rows = spark.read.parquet(folder).filter(F.col("side") == side)
    rows = rows if version is None else rows.filter(F.col("version") <= version)
    return rows.groupBy("id").agg(F.max_by("f", "version").alias("f")).select(F.col("id").cast(id_type).alias(f"{side}_id"), "f")


def fold_in(cells: DataFrame, fixed: DataFrame, side: str, rank: int, reg: float = 0.1) -> DataFrame:
    """Factors of the ids on one side ("user" or "item") of cells (user_id, item_id, target, weight) that the other side's fixed factors give: one exact half-step over
    these cells alone. Ids none of whose cells meets a fixed factor aren't there."""
    key, other = (f"{side}_id", "item_id" if side == "user" else "user_id")
    return factors.half_step(cells, fixed, key, other, rank, reg)


def fold_in_new(spark: SparkSession, folder: str, cells: DataFrame, side: str, rank: int, reg: float = 0.1) -> int:
    """Folds the ids of cells that the newest version lacks into a new version, which holds them alone; returns the number of the newest version, which stays
    where there was nothing to fold in. Factors known already stay as they are and aren't computed again."""
    key, other = (f"{side}_id", "item" if side == "user" else "user")
    known = load_factors(spark, folder, side, id_type=cells.schema[key].dataType.simpleString())
    fixed = load_factors(spark, folder, other, id_type=cells.schema[f"{other}_id"].dataType.simpleString())
    new = cells.join(known.select(key), key, "left_anti")
    newest = spark.read.parquet(folder).agg(F.max("version")).first()[0]
    made = stored(fold_in(new, fixed, side, rank, reg))
    if made.isEmpty():
        return newest
    version = newest + 1
    made.select(F.lit(side).alias("side"), F.col(key).cast("string").alias("id"), "f").write.parquet(f"{folder}/version={version}")
    return version


# Conjugate gradients.


def explicit_cells(cells: DataFrame) -> DataFrame:
    """Cells with target and weight as cells with w and q."""
    return cells.withColumns({"w": F.col("weight"), "q": F.col("weight") * F.col("target")})


def counted_cells(cells: DataFrame, alpha: float = 40.0) -> DataFrame:
    """Cells with a count n as cells with w and q, where c = 1 + alpha n is the confidence that the pair is liked."""
    return cells.withColumns({"w": F.col("n") * alpha, "q": F.col("n") * alpha + 1.0})


def gram(fixed: DataFrame, rank: int) -> list[list[float]]:
    """The sum of f f' over all factors."""
    f = lambda i: F.get("f", F.lit(i))
    row = fixed.agg(*(F.coalesce(F.sum(f(i) * f(j)), F.lit(0.0)) for i in range(rank) for j in range(rank))).first()
    return [list(row[i * rank : (i + 1) * rank]) for i in range(rank)]


def _times(matrix: list[list[float]] | None, reg: float, v: Column, rank: int) -> Column:
    """(matrix + reg I) v."""
    one = lambda i: sum((F.get(v, F.lit(j)) * matrix[i][j] for j in range(rank)), F.get(v, F.lit(i)) * reg) if matrix else F.get(v, F.lit(i)) * reg
    return F.array(*(one(i) for i in range(rank)))


def _plus(a: Column, b: Column, by: Column | float) -> Column:
    """a + by b."""
    return F.zip_with(a, b, lambda x, y: x + y * by)


def cg_half_step(cells: DataFrame, fixed: DataFrame, start: DataFrame | None, key: str, other: str, rank: int, reg: float, steps: int = 3, matrix: list[list[float]] | None = None) -> DataFrame:
    """key, f after so many steps of conjugate gradients from the factors in ``start`` (zeros where it has none), given the other side's ``fixed``.

    cells: key, other, w, q. Each step's state, three vectors an id, is written out, so plans don't grow with steps. Ids whose residual is zero stand still.
    """
    f = lambda i: F.get("f", F.lit(i))
    zeros = F.array(*(F.lit(0.0) for _ in range(rank)))
    beside = cells.select(key, other, "w", "q").join(fixed.select(other, "f"), other)
    product = lambda v: F.array(*(F.sum(F.col("w") * arrays.dot(F.col("f"), v) * f(i)) for i in range(rank)))
    right = F.array(*(F.sum(F.col("q") * f(i)) for i in range(rank))).alias("_b")
    if start is None:
        # From zero no cell meets its own id's factors.
        sums = beside.groupBy(key).agg(right).withColumns({"_x": zeros, "_ax": zeros})
    else:
        begun = cells.select(key).distinct().join(start.select(key, F.col("f").alias("_x")), key, "left").withColumn("_x", F.coalesce("_x", zeros))
        sums = beside.join(begun, key).groupBy(key, "_x").agg(product(F.col("_x")).alias("_ax"), right)
    r = _plus(_plus(F.col("_b"), F.col("_ax"), -1.0), _times(matrix, reg, F.col("_x"), rank), -1.0)
    state = sums.select(key, F.col("_x").alias("x"), r.alias("r"))
    state = stored(state.select(key, "x", "r", F.col("r").alias("p"), arrays.dot(F.col("r"), F.col("r")).alias("rr")))
    for _ in range(steps):
        sums = beside.join(state.select(key, "p"), key).groupBy(key).agg(product(F.col("p")).alias("_ap"))
        now = state.join(sums, key).withColumn("_ap", _plus(F.col("_ap"), _times(matrix, reg, F.col("p"), rank), 1.0))
        now = now.withColumn("_alpha", F.coalesce(F.try_divide("rr", arrays.dot(F.col("p"), F.col("_ap"))), F.lit(0.0)))
        now = now.withColumns({"x": _plus(F.col("x"), F.col("p"), F.col("_alpha")), "r": _plus(F.col("r"), F.col("_ap"), -F.col("_alpha"))})
        now = now.withColumn("_rr", arrays.dot(F.col("r"), F.col("r")))
        state = stored(now.select(key, "x", "r", _plus(F.col("r"), F.col("p"), F.coalesce(F.try_divide("_rr", "rr"), F.lit(0.0))).alias("p"), F.col("_rr").alias("rr")))
    return state.select(key, F.col("x").alias("f"))


def als_cg(cells: DataFrame, rank: int = 4, iterations: int = 3, reg: float = 0.1, steps: int = 3, seed: int = 7, counts: bool = False) -> tuple[DataFrame, DataFrame]:
    """User and item factors of cells with user_id, item_id, w and q by alternating half-steps, each begun where the last one of its side ended. counts: cells that
    aren't there count too (with the weight 1 and the target 0)."""
    users, items = (stored(factors.initial(cells, k, rank, s)) for k, s in (("user_id", seed), ("item_id", seed + 1)))
    for _ in range(iterations):
        items = cg_half_step(cells, users, items, "item_id", "user_id", rank, reg, steps, gram(users, rank) if counts else None)
        users = cg_half_step(cells, items, users, "user_id", "item_id", rank, reg, steps, gram(items, rank) if counts else None)
    return users, items
