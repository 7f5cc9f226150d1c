"""Boosted trees and ridge regression on fold rows, ensembles, recursion and ablation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import fold_fit, metrics, recursion
from tessera.operators.folds import assign, purged, stored

# fixed values
SEEDS = (42, 7, 123)
ENSEMBLE_SEEDS = (42, 7, 123, 2024, 999)


def assembler(df: DataFrame, features: list[str], categorical: list[str] | None = None) -> list:
    """Stages that make the vector: categories as indices with their metadata, unknown numbers as they are."""
    cats = categorical or []
    stages = [StringIndexer(inputCols=cats, outputCols=[f"{c}_ix" for c in cats], handleInvalid="keep")] if cats else []
    return [*stages, VectorAssembler(inputCols=[*(f for f in features if f not in cats), *(f"{c}_ix" for c in cats)], outputCol="features", handleInvalid="keep")]


def filled(df: DataFrame, features: list[str]) -> DataFrame:
    """Unknown numbers as 0, as every tree then sees the same value for them."""
    return df.fillna(0.0, [f for f in features if dict(df.dtypes)[f] not in ("string",)])


def gbt(target: str, seed: int = 42, rounds: int = 20, depth: int = 4, rate: float = 0.1, weight: str | None = None, stop_on: str | None = None) -> GBTRegressor:
    """Trees on the absolute error; stop_on: a flag column of the rows that end training early."""
    m = GBTRegressor(labelCol=target, lossType="absolute", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, maxBins=64)
    m = m.setWeightCol(weight) if weight else m
    return m.setValidationIndicatorCol(stop_on) if stop_on else m


def classifier(df: DataFrame, target: str, seed: int = 42, rounds: int = 20, weight: str | None = None):
    """Boosted trees for two classes, a forest for more."""
    two = df.select(target).distinct().count() <= 2
    m = GBTClassifier(labelCol=target, maxIter=rounds, maxDepth=4, seed=seed) if two else RandomForestClassifier(labelCol=target, numTrees=rounds, maxDepth=6, seed=seed)
    return m.setWeightCol(weight) if weight else m


def fit_predict(train: DataFrame, rows: DataFrame, features: list[str], model, categorical: list[str] | None = None) -> DataFrame:
    """rows with the model's prediction."""
    train, rows = filled(train, features), filled(rows, features)
    fitted = Pipeline(stages=[*assembler(train, features, categorical), model]).fit(train)
    return fitted.transform(rows)


def cv_oof(assigned: DataFrame, key: list[str], target: str, features: list[str], seeds: tuple[int, ...] = SEEDS[:1], stages: list | None = None, categorical: list[str] | None = None, **settings) -> DataFrame:
    """Out-of-fold predictions (key, fold_id, seed, target, prediction) of rows from folds.assign(): one fit a fold and seed. ``stages`` (fold_fit) are fitted
    on every fold's training rows first; ``features`` may name what they add. The rows are
    written once (folds.stored), so that fits read their fold's files and don't make its features again."""
    if stages:
        assigned = fold_fit.fitted(assigned, stages)
    assigned = stored(assigned)
    ids = [r[0] for r in assigned.select("fold_id").distinct().orderBy("fold_id").collect()]
    out = []
    for f in ids:
        part = assigned.where(F.col("fold_id") == f)
        for s in seeds:
            p = fit_predict(part.where("role = 'train'"), part.where("role = 'valid'"), features, gbt(target, s, **settings), categorical)
            out.append(p.select(*key, "fold_id", F.lit(s).alias("seed"), target, "prediction"))
    return reduce(DataFrame.union, out)


def ridge(df: DataFrame, target: str, features: list[str], alpha: float):
    """Linear least squares with alpha * |w|^2: Spark scales the target by its deviation and the loss by rows, so the parameter is alpha * sd / n."""
    n, sd = df.agg(F.count(target), F.stddev_pop(target)).first()
    model = LinearRegression(labelCol=target, elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha * (sd or 1.0) / max(n, 1))
    return Pipeline(stages=[*assembler(df, features), model]).fit(filled(df, features))


def vector_names(rows: DataFrame, column: str = "features") -> list[str]:
    """The names of a vector's places, from the metadata that its assembler wrote."""
    attributes = rows.schema[column].metadata["ml_attr"]["attrs"]
    return [a["name"] for a in sorted((a for kind in attributes.values() for a in kind), key=lambda a: a["idx"])]


def importance(fitted, rows: DataFrame) -> list[tuple[str, float]]:
    """(feature, importance), greatest first, of a fitted pipeline of fit_predict(); a category is named by its column. rows: any that it transforms."""
    names = [n.removesuffix("_ix") for n in vector_names(fitted.transform(rows))]
    values = fitted.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))


def shares(train: DataFrame, features: list[str], model, categorical: list[str] | None = None) -> dict[str, float]:
    """Each feature's share of all importance in a model of these rows."""
    train = filled(train, features)
    found = importance(Pipeline(stages=[*assembler(train, features, categorical), model]).fit(train), train)
    total = sum(v for _, v in found) or 1.0
    return {n: v / total for n, v in found}


def recursive_forecast(train: DataFrame, val: DataFrame, groups: list[str], axis: str, target: str, lags: list[int], rounds: int = 20, windows: list[int] | None = None) -> DataFrame:
    """recursion.chosen() with boosted trees on lags (and rolling windows): groups, axis, step, recursive, imputed, choice, prediction."""
    windows = windows or []
    names = recursion.feature_names(lags, windows)

    def fit(known: DataFrame) -> recursion.Predict:
        fitted = Pipeline(stages=[*assembler(known, names), gbt(target, rounds=rounds)]).fit(known)
        return lambda rows: fitted.transform(rows)

    return recursion.chosen(train, val, groups, axis, target, lags, windows, fit)[0]


def ablation(assigned: DataFrame, key: list[str], target: str, families: dict[str, list[str]], rounds: int = 10) -> DataFrame:
    """(family, fold_id, delta): how much the fold's MAE changes without a family's features."""
    every = [c for cols in families.values() for c in cols]

    def mae(features: list[str]) -> DataFrame:
        oof = cv_oof(assigned, key, target, features, rounds=rounds)
        return oof.groupBy("fold_id").agg(F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("mae"))

    base = mae(every).withColumnRenamed("mae", "base")
    out = [mae([c for c in every if c not in cols]).join(base, "fold_id").select(F.lit(f).alias("family"), "fold_id", (F.col("mae") - F.col("base")).alias("delta")) for f, cols in families.items()]
    return reduce(DataFrame.union, out)


def early_rounds(train: DataFrame, target: str, features: list[str], stop_on: str, most: int = 100, **settings) -> int:
    """How many rounds a model is worth: a tenth more than those after which the rows flagged by ``stop_on`` gain no more."""
    fitted = Pipeline(stages=[*assembler(train, features), gbt(target, rounds=most, stop_on=stop_on, **settings)]).fit(filled(train, features))
    return max(1, int(fitted.stages[-1].getNumTrees * 1.1))


def transform_probe(train: DataFrame, valid: DataFrame, key: list[str], target: str, features: list[str], scored: str, rounds: int = 20) -> DataFrame:
    """metrics.transform_choice() of one model a transform of the target, fitted on train and put back to the target's own scale on valid."""
    out = []
    for name in ("none", "sqrt", "log1p"):
        forth, back = metrics.transforms(name)
        p = fit_predict(train.withColumn("_z", forth(F.col(target))), valid, features, gbt("_z", rounds=rounds))
        out.append(p.select(*key, F.lit(name).alias("transform"), target, scored, back(F.col("prediction")).alias("prediction")))
    return metrics.transform_choice(reduce(DataFrame.union, out), "transform", target, "prediction", scored)


def strict_cv(df: DataFrame, rank: str, periods: int, key: list[str], target: str, features: list[str], splits: int = 4, embargo: int = 2, **settings) -> DataFrame:
    """fold_id, n, mae, rmse and so on of a re-run on purged walk-forward folds with the settings that were reported."""
    from tessera.operators.folds import oof_metrics

    return oof_metrics(cv_oof(assign(df, rank, purged(periods, splits, embargo)), key, target, features, **settings), target, "prediction")


def without_each(df: DataFrame, rank: str, periods: int, key: list[str], target: str, features: list[str], least: float = 0.30, **settings) -> DataFrame:
    """feature, share, loo_delta, relative: how much the MAE of strict_cv() changes without each feature that has ``least`` of all importance in a model of all rows."""
    share = shares(df, features, gbt(target, **settings))
    mae = lambda names: strict_cv(df, rank, periods, key, target, names, **settings).agg(F.avg("mae")).first()[0]
    chosen = [f for f in features if share[f] >= least and len(features) > 1]
    base = mae(features) if chosen else 0.0
    rows = [(f, share[f], mae([x for x in features if x != f]) - base) for f in chosen]
    return df.sparkSession.createDataFrame([(*r, abs(r[2]) / base if base else None) for r in rows], "feature string, share double, loo_delta double, relative double")
