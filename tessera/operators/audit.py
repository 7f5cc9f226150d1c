"""Verdicts over small frames of metrics: CASE rules and nothing else."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_verdict(df: DataFrame, reported: str = "reported_mae", strict: str = "strict_mae") -> DataFrame:
    """Adds gap and verdict: over 25 % CRITICAL, over 10 % WARNING."""
    gap = F.try_divide(F.col(strict) - F.col(reported), F.col(reported))
    return df.withColumn("gap", gap).withColumn("verdict", F.when(gap > 0.25, "CRITICAL").when(gap > 0.10, "WARNING").otherwise("PASS"))


def validator_verdict(df: DataFrame, classification: bool = False) -> DataFrame:
    """From gap, max_share (of the most important feature) and has_suspect (by the two-signal rule): cv_integrity (of regressions only, as gap_verdict()), importance_concentration (over half of all importance is a
    WARNING), leakage_two_signal (a suspect is CRITICAL) and verdict, the worst of them. Unknown values pass."""
    over = lambda c, bar: F.coalesce(F.col(c) > bar, F.lit(False))
    cv = F.lit("PASS") if classification else F.when(over("gap", 0.25), "CRITICAL").when(over("gap", 0.10), "WARNING").otherwise("PASS")
    checks = {"cv_integrity": cv, "importance_concentration": F.when(over("max_share", 0.50), "WARNING").otherwise("PASS"), "leakage_two_signal": F.when(F.coalesce("has_suspect", F.lit(False)), "CRITICAL").otherwise("PASS")}
    out = df.withColumns(checks)
    any_is = lambda v: F.array_contains(F.array(*checks), v)
    return out.withColumn("verdict", F.when(any_is("CRITICAL"), "CRITICAL").when(any_is("WARNING"), "WARNING").otherwise("PASS"))


def gap_attribution(folds: DataFrame, reported: float) -> DataFrame:
    """From (train_size, mae) of folds: whether the latest fold matches the reported MAE (CV_SCHEME) or not (REAL_DIVERGENCE), and how
    steadily errors fall with more training rows."""
    w = Window.orderBy("train_size")
    steps = folds.withColumn("_fell", (F.col("mae") < F.lag("mae").over(w)).cast("double"))
    g = steps.agg(F.max_by("mae", "train_size").alias("latest_mae"), F.avg("_fell").alias("monotonicity"), F.avg("mae").alias("mean_mae"))
    off = F.abs(F.col("latest_mae") - reported) / reported
    explained = F.coalesce(F.try_divide(F.col("mean_mae") - F.col("latest_mae"), F.col("mean_mae") - reported), F.lit(0.0))
    return g.select("latest_mae", "monotonicity", off.alias("latest_off"), explained.alias("explained"), F.when(off <= 0.15, "CV_SCHEME").otherwise("REAL_DIVERGENCE").alias("cause"))


def ablation_decision(df: DataFrame, reference: float) -> DataFrame:
    """From (family, fold_id, delta): a family is to go if errors fall without it by over 2 % and by more than chance among so many families."""
    n = df.select("family").distinct().agg(F.count("*").alias("_n"))
    g = df.groupBy("family").agg(F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("std_delta")).crossJoin(F.broadcast(n))
    d = F.try_divide(F.col("mean_delta"), F.nullif("std_delta", F.lit(0.0)))
    bar = -2 * F.sqrt(F.ln(1 + F.col("_n")))
    drop = (F.col("mean_delta") < 0) & (F.abs("mean_delta") > 0.02 * reference) & (F.coalesce(d, F.lit(-math.inf)) < bar)
    return g.select("family", "mean_delta", d.alias("effect"), drop.alias("drop"))


def fold_stability(folds: DataFrame) -> DataFrame:
    """Variation of the folds' MAE: over 0.4 RISK, over 0.8 or a fold beyond three medians INVALID."""
    g = folds.agg(F.try_divide(F.stddev_pop("mae"), F.avg("mae")).alias("variation"), F.max("mae").alias("worst"), F.median("mae").alias("middle"))
    return g.select("variation", "worst", "middle", F.when((F.col("variation") > 0.8) | (F.col("worst") > 3 * F.col("middle")), "CV_INVALID").when(F.col("variation") > 0.4, "CV_RISK").otherwise("CV_OK").alias("verdict"))


def too_good(mae: float, sigma: float) -> str:
    """A cross-validated error that is a tiny part of the target's deviation points at a leak."""
    share = mae / sigma if sigma else math.inf
    return "CV_INVALID" if share < 0.01 else "CV_RISK" if share < 0.05 else "CV_OK"


def importance_stability(df: DataFrame) -> DataFrame:
    """From (fold_id, feature, importance): Spearman correlation of each pair of folds over features that both have."""
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col("a.fold_id") < F.col("b.fold_id"))).select(F.col("a.fold_id").alias("fold_a"), F.col("b.fold_id").alias("fold_b"), F.col("a.importance").alias("x"), F.col("b.importance").alias("y"))

    def rank(c):
        own = Window.partitionBy("fold_a", "fold_b")
        return F.rank().over(own.orderBy(c)) + (F.count("*").over(own.partitionBy("fold_a", "fold_b", c)) - 1) / 2

    r = pairs.withColumns({"rx": rank("x"), "ry": rank("y")})
    return r.groupBy("fold_a", "fold_b").agg(F.corr("rx", "ry").alias("spearman"))


def importance_verdict(pairs: DataFrame) -> DataFrame:
    g = pairs.agg(F.median("spearman").alias("median_spearman"))
    return g.withColumn("verdict", F.when(F.col("median_spearman") < 0.2, "CV_INVALID").when(F.col("median_spearman") < 0.5, "CV_RISK").otherwise("CV_OK"))


def fold_drift(pred: DataFrame, y: str, p: str) -> DataFrame:
    """fold_id, drifted: predictions whose mean is off by 0.3 of the target's, or that spread less than 0.4 of it."""
    g = pred.groupBy("fold_id").agg(F.avg(y).alias("ym"), F.stddev_samp(y).alias("ys"), F.avg(p).alias("pm"), F.stddev_samp(p).alias("ps"))
    return g.select("fold_id", ((F.abs(F.col("pm") - F.col("ym")) > 0.3 * F.abs("ym")) | (F.col("ps") < 0.4 * F.col("ys"))).alias("drifted"))


def fold_outliers(folds: DataFrame) -> DataFrame:
    """fold_id, mae, outlier: above the mean by over 1.5 population deviations."""
    w = Window.partitionBy()
    return folds.select("fold_id", "mae", (F.col("mae") > F.avg("mae").over(w) + 1.5 * F.stddev_pop("mae").over(w)).alias("outlier"))


def prediction_distribution(pred: DataFrame, train: DataFrame, y: str, p: str) -> DataFrame:
    """Mean bias over 30 % or spread under 40 % CRITICAL, spread under 65 % WARNING."""
    t = train.agg(F.avg(y).alias("ym"), F.stddev_samp(y).alias("ys"))
    g = pred.agg(F.avg(p).alias("pm"), F.stddev_samp(p).alias("ps")).crossJoin(F.broadcast(t))
    bias, spread = F.try_divide(F.abs(F.col("pm") - F.col("ym")), F.abs("ym")), F.try_divide("ps", "ys")
    return g.select(bias.alias("bias"), spread.alias("spread"), F.when((bias > 0.3) | (spread < 0.4), "CRITICAL").when(spread < 0.65, "WARNING").otherwise("PASS").alias("verdict"))


def collapse(pred: DataFrame, p: str) -> DataFrame:
    """n_labels, verdict: one predicted label for all rows is CRITICAL."""
    return pred.agg(F.count_distinct(p).alias("n_labels")).withColumn("verdict", F.when(F.col("n_labels") == 1, "CRITICAL").otherwise("PASS"))


def plausibility(mae: float, sigma: float, validator: str = "PASS") -> str:
    """An error under 3 % of the deviation (unless the validator passed) or over 80 % of it."""
    if sigma and mae < 0.03 * sigma and validator != "PASS":
        return "CRITICAL"
    return "WARNING" if sigma and mae > 0.8 * sigma else "PASS"


def concentration(importance: DataFrame, top: int = 10) -> DataFrame:
    """feature, share of the top features' importance, concentrated (over half)."""
    best = importance.orderBy(F.desc("importance"), "feature").limit(top)
    share = F.try_divide(F.col("importance"), F.sum("importance").over(Window.partitionBy()))
    return best.select("feature", share.alias("share")).withColumn("concentrated", F.col("share") > 0.5)


def sanity(pred: DataFrame, train: DataFrame, y: str, p: str) -> DataFrame:
    """Nulls or negatives CRITICAL; a greatest prediction over 3 times or under 0.4 of train's WARNING."""
    t = train.agg(F.max(y).alias("y_max"), F.min(y).alias("y_min"))
    g = pred.agg(F.count_if(F.col(p).isNull()).alias("n_null"), F.count_if(F.col(p) < 0).alias("n_negative"), F.max(p).alias("p_max")).crossJoin(F.broadcast(t))
    bad = (F.col("n_null") > 0) | (F.col("n_negative") > 0) & (F.col("y_min") >= 0)
    return g.select("n_null", "n_negative", "p_max", F.when(bad, "CRITICAL").when((F.col("p_max") > 3 * F.col("y_max")) | (F.col("p_max") < 0.4 * F.col("y_max")), "WARNING").otherwise("PASS").alias("verdict"))


def concordance(verdict: str, cause: str) -> str:
    """The validator's verdict; a critical gap that the scheme explains is a warning."""
    return "WARNING" if verdict == "CRITICAL" and cause == "CV_SCHEME" else verdict


def suspects(df: DataFrame, mae: float) -> DataFrame:
    """Adds suspect: a structurally doubtful feature (structural) whose removal hardly changes the error (loo_delta)."""
    return df.withColumn("suspect", F.col("structural") & (F.abs("loo_delta") < 0.05 * mae))


def decide(verdicts: list[str], ablation_drop: bool, cycle: int) -> str:
    """retune or accept; the second cycle always accepts."""
    if cycle >= 2:
        return "accept"
    return "retune" if "CRITICAL" in verdicts or ablation_drop else "accept"


def protected_families(families: dict[str, list[str]], config: dict[str, str], horizon: int) -> set[str]:
    """Families that an ablation may not drop: the target's own lags for panels, seasonal terms for long horizons, what the config names."""
    keep = {f for f in families if f in config.get("protected", "").split(",")}
    if config.get("problem") in ("panel_forecasting", "time_series"):
        keep |= {f for f in families if f in ("lags", "rolling_mean")}
    if horizon > 4:
        keep |= {f for f in families if f.startswith("seasonality")}
    return keep
