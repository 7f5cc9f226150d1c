"""Ridge regression by sufficient statistics: one pass over the rows serves every fold and every penalty.

Each task adds up the products of (1, x - shift, y - shift) by fold, as one small matrix a fold; Spark sums these, and what comes to the driver is
folds * (features + 2)^2 numbers, whatever the number of rows. There a penalty is one Cholesky solve of
(X'X + alpha I) w = X'y with centred columns; the intercept is not penalised. The shift, the columns' means, only keeps digits. Where folds are a
partition of the rows, a fold's training sums are all sums less its own, so the rows are read once and not once a fold.

Nulls and NaN of features count as 0, as trees see them; rows without a target are left out. A fold without training rows has no
coefficients. A column that doesn't vary, or a fold of one row, has the coefficient 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)  # fixed values


def _number(c: str) -> Column:
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def cross_products(rows: DataFrame, target: str, features: list[str], by: str = "fold_id") -> tuple[dict[int, np.ndarray], np.ndarray]:
    """({fold: products of (1, features, target)}, shift): sums of products of the shifted columns."""
    rows = rows.where(F.col(target).isNotNull()).select(F.col(by).cast("int").alias("fold"), *(_number(c).alias(f"c{i}") for i, c in enumerate([*features, target])))
    names = rows.columns[1:]
    means = rows.agg(*(F.avg(c).alias(c) for c in names)).first()
    shift = np.array([0.0, *(m or 0.0 for m in means)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            fold = b.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(b.num_rows), *(c.to_numpy(zero_copy_only=False) for c in b.columns[1:])]) - shift
            for f in np.unique(fold):
                own = x[fold == f]
                sums[int(f)] = sums.get(int(f), 0.0) + own.T @ own
        flat = [m.reshape(-1) for m in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tolist() for m in flat], pa.list_(pa.float64()))], names=["fold", "sums"])

    cells = rows.mapInArrow(run, "fold int, sums array<double>").select("fold", F.posexplode("sums").alias("at", "s")).groupBy("fold", "at").agg(F.sum("s").alias("s"))
    size = len(shift)
    out: dict[int, np.ndarray] = {}
    for r in cells.collect():
        out.setdefault(r.fold, np.zeros(size * size))[r["at"]] = r.s
    return {f: m.reshape(size, size) for f, m in out.items()}, shift


def others(products: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The training sums of folds that part the rows: all less each fold's own."""
    every = sum(products.values())
    return {f: every - m for f, m in products.items()}


def solve(products: np.ndarray, shift: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, coefficients) of one fold and penalty."""
    n = products[0, 0]
    means = products[0] / n
    centred = products - n * np.outer(means, means)
    p = len(shift) - 2
    xx, xy = centred[1:-1, 1:-1].copy(), centred[1:-1, -1]
    still = np.diag(xx) <= 1e-12 * np.maximum(np.diag(products)[1:-1], 1e-300)
    xx[still, :], xx[:, still] = 0.0, 0.0
    lower = np.linalg.cholesky(xx + alpha * np.eye(p) + np.diag(np.where(still, 1.0, 0.0)))
    w = np.linalg.solve(lower.T, np.linalg.solve(lower, np.where(still, 0.0, xy)))
    centre = means + shift
    return np.concatenate([[centre[-1] - centre[1:-1] @ w], w])


def coefficients(rows: DataFrame, target: str, features: list[str], alphas: tuple[float, ...] = ALPHAS, parted: bool = False) -> DataFrame:
    """fold_id, alpha, intercept, w (array by feature). Rows with a role are those of folds.assign(), fitted on the training rows of each fold; parted: rows
    stand once, with the fold that they are to be left out of."""
    if parted:
        products, shift = cross_products(rows, target, features)
        products = others(products)
    else:
        products, shift = cross_products(rows.where("role = 'train'"), target, features)
    found = [(f, a, *solve(m, shift, a)) for f, m in sorted(products.items()) if m[0, 0] > 0.5 for a in alphas]
    made = [(f, float(a), float(b), [float(x) for x in w]) for f, a, b, *w in found]
    return rows.sparkSession.createDataFrame(made, "fold_id int, alpha double, intercept double, w array<double>")


def predict(rows: DataFrame, fitted: DataFrame, features: list[str]) -> DataFrame:
    """The rows of each fold, once for each penalty, with alpha and prediction."""
    terms = [F.col("w")[i] * _number(c) for i, c in enumerate(features)]
    made = rows.join(F.broadcast(fitted), "fold_id")
    return made.select(*rows.columns, "alpha", sum(terms, F.col("intercept")).alias("prediction"))


def probe(rows: DataFrame, target: str, features: list[str], alphas: tuple[float, ...] = ALPHAS, parted: bool = False) -> DataFrame:
    """alpha, mae, n over the rows that each fold leaves out: scored on the folds that all models are scored on."""
    out = predict(rows if parted else rows.where("role = 'valid'"), coefficients(rows, target, features, alphas, parted), features)
    return out.where(F.col(target).isNotNull()).groupBy("alpha").agg(F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("mae"), F.count("*").alias("n"))


def terms(rows: DataFrame, target: str, features: list[str], alpha: float, n: int = 10) -> DataFrame:
    """rank, feature, coefficient: the n largest by size of one fit on all rows."""
    products, shift = cross_products(rows.withColumn("_all", F.lit(0)), target, features, "_all")
    w = solve(products[0], shift, alpha)[1:] if products else []
    found = sorted(zip(features, map(float, w), strict=False), key=lambda x: (-abs(x[1]), x[0]))[:n]
    return rows.sparkSession.createDataFrame([(i + 1, *f) for i, f in enumerate(found)], "rank int, feature string, coefficient double")
