"""Scores of predictions, ensembles and post-processing, all as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.running import running_sums


def mae_by(df: DataFrame, keys: list[str], y: str, p: str, scored: str) -> DataFrame:
    """n, mae and mae of scored rows by keys."""
    e = F.abs(F.col(y) - F.col(p))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(e).alias("mae"), F.avg(F.when(F.col(scored), e)).alias("mae_scored"))


def seed_ensemble(df: DataFrame, key: list[str], p: str, how: str = "mean") -> DataFrame:
    """Prediction and disagreement over the seeds of a row: long form, so seeds are rows."""
    f = {"mean": F.avg, "median": F.median}[how]
    return df.groupBy(*key).agg(f(p).alias("prediction"), F.stddev_pop(p).alias("disagreement"))


def weighted_mae(df: DataFrame, y: str, p: str, w: str) -> DataFrame:
    return df.agg((F.sum(F.abs(F.col(y) - F.col(p)) * F.col(w)) / F.sum(w)).alias("wmae"))


def level_correction(df: DataFrame, group: str, y: str, p: str, w: str, least: int = 30, shrink: float = 0.5) -> DataFrame:
    """group, n, bias to add: the global weighted bias, and half of the rest of a group's own where it has enough rows."""
    e = F.col(w) * (F.col(y) - F.col(p))
    all_ = df.agg((F.sum(e) / F.sum(w)).alias("_all"))
    g = df.groupBy(group).agg(F.count("*").alias("n"), (F.sum(e) / F.sum(w)).alias("_own")).crossJoin(F.broadcast(all_))
    return g.select(group, "n", (F.col("_all") + F.when(F.col("n") >= least, shrink * (F.col("_own") - F.col("_all"))).otherwise(0.0)).alias("bias"))


def apply_level(df: DataFrame, biases: DataFrame, group: str, y: str, p: str, w: str, gain: float = 0.015) -> DataFrame:
    """before and after weighted MAE and whether the correction pays."""
    e = lambda x: F.sum(F.abs(F.col(y) - x) * F.col(w)) / F.sum(w)
    out = df.join(biases.select(group, "bias"), group, "left").agg(e(F.col(p)).alias("before"), e(F.col(p) + F.coalesce("bias", F.lit(0.0))).alias("after"))
    return out.withColumn("applied", F.col("after") < F.col("before") * (1 - gain))


def threshold_sweep(df: DataFrame, y: str, score: str, lo: int = 5, hi: int = 95) -> DataFrame:
    """threshold, tp, fp, fn, f1 for thresholds in hundredths. Scores are counted by hundredth first, so the sweep is over at most 101 rows."""
    cell = F.least(F.greatest(F.floor(F.col(score) * 100 + 1e-9), F.lit(0)), F.lit(100)).cast("int")
    counts = df.groupBy(cell.alias("cell")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    grid = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("cut"))
    hit = F.col("cell") >= F.col("cut")
    out = grid.crossJoin(F.broadcast(counts)).groupBy("cut").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return out.select((F.col("cut") / 100).alias("threshold"), "tp", "fp", "fn", f1.alias("f1"))


def best_threshold(sweep: DataFrame, gain: float = 0.02) -> DataFrame:
    """The threshold of the best F1, or 0.5 where it gains too little."""
    best = sweep.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("best"), F.max("f1").alias("best_f1"), F.max(F.when(F.abs(F.col("threshold") - 0.5) < 1e-9, F.col("f1"))).alias("f1_half"))
    return best.select(F.when(F.col("best_f1") - F.col("f1_half") >= gain, F.col("best")).otherwise(0.5).alias("threshold"), "best_f1", "f1_half")


def roc_auc(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by,) auc: rank sums with average ranks on ties; equal scores are counted before ranks are taken."""
    by = by or []
    c = df.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count("*").alias("n"))
    r = running_sums(c, "s", ["n"], by).select(*by, "pos", "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
    g = r.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("sum_rank"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return g.select(*by, F.try_divide(F.col("sum_rank") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """label, weight: n / (classes * n of the class)."""
    g = df.groupBy(F.col(y).alias("label")).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    return g.select("label", "n", (F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))).alias("weight"))


def normalised_importance(df: DataFrame) -> DataFrame:
    """feature, share: mean importance over folds, adding up to 1."""
    g = df.groupBy("feature").agg(F.avg("importance").alias("m"))
    return g.select("feature", F.try_divide(F.col("m"), F.sum("m").over(Window.partitionBy())).alias("share"))


def skill(df: DataFrame, y: str, p: str, baseline: str) -> DataFrame:
    """mae, baseline's mae and 1 - their ratio."""
    a, b = F.avg(F.abs(F.col(y) - F.col(p))), F.avg(F.abs(F.col(y) - F.col(baseline)))
    return df.agg(a.alias("mae"), b.alias("baseline_mae")).withColumn("skill", 1 - F.try_divide("mae", "baseline_mae"))


def transforms(name: str):
    """(forward, inverse) column functions of none, sqrt and log1p; inverses are clipped at 0."""
    up = lambda c: F.greatest(c, F.lit(0.0))
    return {
        "none": (lambda c: c, up),
        "sqrt": (lambda c: F.sqrt(up(c)), lambda c: up(c) * up(c)),
        "log1p": (lambda c: F.log1p(up(c)), lambda c: up(F.expm1(c))),
    }[name]


def probability_ensemble(df: DataFrame, key: list[str], label: str, p: str) -> DataFrame:
    """The class with the greatest mean probability over the seeds of a row (the least of equals), and that mean. Rows: key, seed, label, p."""
    means = df.groupBy(*key, label).agg(F.avg(p).alias("_p"))
    return means.groupBy(*key).agg(F.min(F.struct((-F.col("_p")).alias("p"), F.col(label).alias("v"))).alias("_b")).select(*key, F.col("_b.v").alias("prediction"), (-F.col("_b.p")).alias("probability"))


def recursion_choice(df: DataFrame, step: str, y: str, recursive: str, last_known: str) -> DataFrame:
    """A row a step and one for all (step null): the MAE of recursive predictions and of the last known value, and which is better; equals go to recursion."""
    err = lambda p: F.avg(F.abs(F.col(y) - F.col(p)))
    out = df.rollup(step).agg(F.count("*").alias("n"), err(recursive).alias("recursive_mae"), err(last_known).alias("last_known_mae"))
    return out.withColumn("choice", F.when(F.col("recursive_mae") <= F.col("last_known_mae"), "recursive").otherwise("last_known"))


def transform_choice(df: DataFrame, transform: str, y: str, p: str, scored: str) -> DataFrame:
    """transform, mae over scored rows, and whether it is the least (of equals the first by name)."""
    mae = df.where(F.col(scored)).groupBy(transform).agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"))
    best = mae.agg(F.min(F.struct("mae", transform)).alias("b"))
    return mae.crossJoin(F.broadcast(best)).select(transform, "mae", (F.col(transform) == F.col(f"b.{transform}")).alias("chosen"))
