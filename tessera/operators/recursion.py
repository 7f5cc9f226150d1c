"""Forecasts over several periods by a model that reads its own past predictions, against one that reads the last known value.

Each group's state is a ring: an array of its last ``depth`` target values, from which all lag and rolling features of the next period are
expressions. A period joins its rows to the rings, predicts, and writes the advanced rings together with the predictions; the next period reads
them. So a step's plan is as long as the first one's, however many periods follow, a lost executor costs one step, and a step moves one row a group.

Defined results: null targets are no history. A lag beyond a group's history is its oldest-known stand-in, the last value; a group without history has 0, and rolling
deviations of fewer than two values are 0. A group that has no row in a period keeps its ring. Predictions lie between 0 and ``ceiling`` times the largest training target.
Rows of ``val`` that share group and period are an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import features, metrics
from tessera.sources.shared import own_path

Predict = Callable[[DataFrame], DataFrame]  # adds a column prediction
CEILING = 10.0  # fixed value


def rings(train: DataFrame, groups: list[str], axis: str, target: str, depth: int) -> DataFrame:
    """groups, ring: each group's last ``depth`` values along the axis, the latest last."""
    late = Window.partitionBy(*groups).orderBy(F.desc(axis), F.desc(target))
    last = train.where(F.col(target).isNotNull()).select(*groups, F.col(axis).alias("_t"), F.col(target).cast("double").alias("_y"), F.row_number().over(late).alias("_n")).where(F.col("_n") <= depth)
    return last.groupBy(*groups).agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("_n"), F.col("_y")))), lambda x: x["_y"]).alias("ring"))


def _squares(values: Column, mean: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))


def ring_features(ring: Column, lags: list[int], windows: list[int]) -> list[Column]:
    """lag_k, roll_mean_w and roll_std_w of the period after the ring's last value."""
    n = F.coalesce(F.size(ring), F.lit(0))
    last = F.coalesce(F.get(ring, n - 1), F.lit(0.0))
    out = [F.coalesce(F.get(ring, n - k), last).alias(f"lag_{k}") for k in lags]
    for w in windows:
        part = F.slice(ring, F.greatest(n - w + 1, F.lit(1)), F.lit(w))
        size = F.least(n, F.lit(w))
        mean = F.try_divide(F.aggregate(part, F.lit(0.0), lambda a, x: a + x), size)
        squares = _squares(part, mean)
        out.append(F.coalesce(mean, F.lit(0.0)).alias(f"roll_mean_{w}"))
        out.append(F.when(size > 1, F.sqrt(F.try_divide(squares, size - 1))).otherwise(F.lit(0.0)).alias(f"roll_std_{w}"))
    return out


def feature_names(lags: list[int], windows: list[int]) -> list[str]:
    return [*(f"lag_{k}" for k in lags), *(f"roll_{s}_{w}" for w in windows for s in ("mean", "std"))]


def train_features(train: DataFrame, groups: list[str], axis: str, target: str, lags: list[int], windows: list[int]) -> DataFrame:
    """The training rows with the same features, of rows whose lags are all known."""
    out = train.select("*", *features.lags(target, groups, axis, lags), *features.rolls(target, groups, axis, windows))
    return out.dropna(subset=[f"lag_{max(lags)}"]).fillna(0.0, [f"roll_{s}_{w}" for w in windows for s in ("mean", "std")])


def imputed(train: DataFrame, val: DataFrame, groups: list[str], axis: str, target: str, lags: list[int], windows: list[int]) -> DataFrame:
    """val with features as if the last known value went on: lags and means are that value, deviations 0."""
    last = rings(train, groups, axis, target, 1)
    value = F.coalesce(F.get("ring", F.lit(0)), F.lit(0.0))
    names = [F.lit(0.0).alias(n) if n.startswith("roll_std") else value.alias(n) for n in feature_names(lags, windows)]
    return val.join(last, groups, "left").select(*val.columns, *names)


def forecast(
    train: DataFrame, val: DataFrame, groups: list[str], axis: str, target: str, lags: list[int], windows: list[int], predict: Predict, covariates: tuple[str, ...] = (), ceiling: float = CEILING
) -> DataFrame:
    """groups, axis, step (from 1), recursive, imputed: both forecasts of every row of val."""
    rows = val.select(*groups, axis, *covariates)
    if not rows.groupBy(*groups, axis).count().where("count > 1").isEmpty():
        raise ValueError(f"rows to forecast share {[*groups, axis]}")
    depth = max([*lags, *windows])
    top = (train.agg(F.max(target).cast("double")).first()[0] or 0.0) * ceiling
    bounded = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(top))
    spark, path = train.sparkSession, own_path(train.sparkSession, "rings")
    state = rings(train, groups, axis, target, depth)
    state.write.parquet(f"{path}/start")
    state = spark.read.schema(state.schema).parquet(f"{path}/start")
    periods = [p for (p,) in rows.select(axis).distinct().orderBy(axis).collect()]
    for i, p in enumerate(periods):
        now = rows.where(F.col(axis) == p).join(state, groups, "left").select(*groups, axis, *covariates, *ring_features(F.col("ring"), lags, windows))
        made = predict(now).select(*groups, axis, bounded("prediction").alias("recursive"))
        longer = F.concat(F.coalesce("ring", F.array().cast("array<double>")), F.array("recursive"))
        kept = F.slice(longer, F.greatest(F.size(longer) - depth + 1, F.lit(1)), F.lit(depth))
        ring = F.when(F.col("recursive").isNotNull(), kept).otherwise(F.col("ring")).alias("ring")
        state.join(made, groups, "full").select(*groups, ring, axis, "recursive").write.parquet(f"{path}/steps/step={i + 1}")
        state = spark.read.parquet(f"{path}/steps/step={i + 1}").select(*groups, "ring")
    flat = predict(imputed(train, rows, groups, axis, target, lags, windows)).select(*groups, axis, bounded("prediction").alias("imputed"))
    if not periods:
        return flat.select(*groups, axis, F.lit(0).alias("step"), F.col("imputed").alias("recursive"), "imputed")
    steps = spark.read.parquet(f"{path}/steps").where("recursive is not null")
    return steps.select(*groups, axis, F.col("step").cast("int").alias("step"), "recursive").join(flat, [*groups, axis])


def chosen(
    train: DataFrame, val: DataFrame, groups: list[str], axis: str, target: str, lags: list[int], windows: list[int], fit: Callable[[DataFrame], Predict], covariates: tuple[str, ...] = (), scored: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(forecast, choices). As many of the last training periods as val has are forecast from those before them; of each step, and over all, the
    way with the smaller error on ``scored`` rows is chosen (equals go to recursion), and the forecast of val takes it: choice, prediction. Steps without scored rows take the choice over all."""
    horizon = val.select(axis).distinct().count()
    cut = train.select(axis).distinct().orderBy(F.desc(axis)).limit(max(1, horizon)).agg(F.min(axis)).first()[0]
    early, late = train.where(F.col(axis) < cut), train.where(F.col(axis) >= cut)
    made = forecast(early, late, groups, axis, target, lags, windows, fit(train_features(early, groups, axis, target, lags, windows)), covariates)
    held = made.join(late.select(*groups, axis, target), [*groups, axis]).where(F.col(target).isNotNull() if scored is None else scored)
    choices = metrics.recursion_choice(held, "step", target, "recursive", "imputed")
    overall = choices.where("step is null").select(F.col("choice").alias("_all")).first()
    out = forecast(train, val, groups, axis, target, lags, windows, fit(train_features(train, groups, axis, target, lags, windows)), covariates)
    by_step = F.broadcast(choices.where("step is not null").select("step", "choice"))
    out = out.join(by_step, "step", "left").withColumn("choice", F.coalesce("choice", F.lit(overall[0] if overall else "recursive")))
    return out.withColumn("prediction", F.when(F.col("choice") == "recursive", F.col("recursive")).otherwise(F.col("imputed"))), choices
