"""Distribution shift, drift and leakage statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.running import exact_percentiles, running_sums


def long_form(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep, feature, value) rows without nulls: one pass for all columns."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*(keep or []), F.inline(cells)).where(F.col("value").isNotNull() & ~F.isnan("value"))


def ks(a: DataFrame, b: DataFrame, columns: list[str], least: int = 20, d_min: float = 0.15, p_max: float = 0.01) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov by column: statistic, p_value, flagged. Equal values are counted before anything is ordered."""
    both = long_form(a, columns).withColumn("side", F.lit(0)).union(long_form(b, columns).withColumn("side", F.lit(1)))
    counts = both.groupBy("feature", "value").agg(F.count_if(F.col("side") == 0).alias("x"), F.count_if(F.col("side") == 1).alias("y"))
    run = running_sums(counts, "value", ["x", "y"], ["feature"], few=True)
    steps = run.select("feature", F.col("cum_x").alias("cx"), F.col("cum_y").alias("cy"), F.col("all_x").alias("nx"), F.col("all_y").alias("ny"))
    gap = F.abs(F.try_divide(F.col("cx"), F.col("nx")) - F.try_divide(F.col("cy"), F.col("ny")))
    out = steps.groupBy("feature").agg(F.max(gap).alias("statistic"), F.max("nx").alias("n_a"), F.max("ny").alias("n_b")).where((F.col("n_a") >= least) & (F.col("n_b") >= least))
    n = F.col("n_a").cast("double") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))
    lam = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * F.col("statistic")
    p = F.least(F.greatest(2 * F.exp(-2 * lam * lam), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("p_value", p).withColumn("flagged", (F.col("statistic") > d_min) & (F.col("p_value") < p_max))


def mean_shift(mu_a: Column, var_a: Column, n_a: Column, mu_b: Column, var_b: Column, n_b: Column, least: int = 5) -> Column:
    """|difference of means| over the pooled population deviation; null with few rows, 0 without spread."""
    pooled = F.sqrt((var_a + var_b) / 2)
    return F.when((n_a >= least) & (n_b >= least), F.coalesce(F.try_divide(F.abs(mu_a - mu_b), F.nullif(pooled, F.lit(0.0))), F.lit(0.0)))


def standardised_shift(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """feature, shift of each column."""
    both = long_form(a, columns).withColumn("side", F.lit(0)).union(long_form(b, columns).withColumn("side", F.lit(1)))
    v = lambda s: F.when(F.col("side") == s, F.col("value"))
    g = both.groupBy("feature").agg(*(f(v(s)).alias(f"{n}{s}") for s in (0, 1) for f, n in ((F.avg, "m"), (F.var_pop, "v"), (F.count, "n"))))
    return g.select("feature", mean_shift(*(F.col(c) for c in ("m0", "v0", "n0", "m1", "v1", "n1"))).alias("shift"))


def drift(train: DataFrame, val: DataFrame, columns: list[str], rank: str, recent: int = 14) -> DataFrame:
    """feature, full_shift, recent_shift: val against all of train and against its last ``recent`` periods."""
    last = train.agg(F.max(rank).alias("_last"))
    t = train.crossJoin(F.broadcast(last)).withColumn("_recent", F.col(rank) > F.col("_last") - recent)
    both = long_form(t, columns, ["_recent"]).withColumn("side", F.lit(0)).unionByName(long_form(val.withColumn("_recent", F.lit(False)), columns, ["_recent"]).withColumn("side", F.lit(1)))
    pick = {"f": F.col("side") == 0, "r": (F.col("side") == 0) & F.col("_recent"), "v": F.col("side") == 1}
    g = both.groupBy("feature").agg(*(f(F.when(cond, F.col("value"))).alias(f"{n}_{k}") for k, cond in pick.items() for f, n in ((F.avg, "m"), (F.var_pop, "s"), (F.count, "n"))))
    three = lambda k: (F.col(f"m_{k}"), F.col(f"s_{k}"), F.col(f"n_{k}"))
    return g.select("feature", mean_shift(*three("f"), *three("v")).alias("full_shift"), mean_shift(*three("r"), *three("v")).alias("recent_shift"))


def drift_gate(found: DataFrame, rel_min: float = 0.25, frac_min: float = 0.60, least: int = 12, better: float = 0.05) -> DataFrame:
    """n_features, rel (relative fall of the mean shift), frac_improved, and whether a sliding window is called for."""
    g = found.where("full_shift is not null and recent_shift is not null").agg(F.count("*").alias("n_features"), F.avg("full_shift").alias("f"), F.avg("recent_shift").alias("r"), F.avg((F.col("full_shift") - F.col("recent_shift") > better).cast("double")).alias("frac_improved"))
    rel = F.coalesce(F.try_divide(F.col("f") - F.col("r"), F.col("f")), F.lit(0.0))
    return g.select("n_features", rel.alias("rel"), "frac_improved").withColumn("sliding", (F.col("n_features") >= least) & (F.col("rel") >= rel_min) & (F.col("frac_improved") >= frac_min))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr of every pair over rows that are complete: one aggregate."""
    complete = df.dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return complete.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs)).alias("p")).select(F.inline("p"))


def signal(df: DataFrame, columns: list[str], target: str, least: float = 0.05) -> DataFrame:
    """feature, abs_corr with the target, has_signal."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.abs(F.corr(c, target)).alias("abs_corr")) for c in columns))
    return df.agg(cells.alias("p")).select(F.inline("p")).withColumn("has_signal", F.coalesce(F.col("abs_corr") >= least, F.lit(False)))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, skewness (population)."""
    return long_form(df, columns).groupBy("feature").agg(F.skewness("value").alias("skewness"))


def percentiles(df: DataFrame, column: str, at: tuple[float, ...] = (0.01, 0.25, 0.75, 0.99)) -> DataFrame:
    """One row of exact percentiles, p01, p25 ..."""
    return exact_percentiles(df, column, {f"p{round(p * 100):02d}": p for p in at})


def weights_from_scores(df: DataFrame, score: str, auc: float | None = None, auc_min: float = 0.55) -> DataFrame:
    """Adds weight: clip(1 - p, 0.1, 10) over its mean; 1 for all below the AUC that calls for it."""
    if auc is not None and auc < auc_min:
        return df.withColumn("weight", F.lit(1.0))
    raw = F.least(F.greatest(1 - F.col(score), F.lit(0.1)), F.lit(10.0))
    mean = df.agg(F.avg(raw).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn("weight", raw / F.col("_mean")).drop("_mean")


# fixed values: patterns of names that tell of the future, and marks of features that are made from the target's past;
# "_ or a word's edge" is spelled so that it holds at a name's start too, and a lag may be written with an underscore, as features.lags() does
FUTURE = (
    r"_lead[_\d]",
    r"(?:_|\b)future",
    r"_t\+\d+",
    r"_lag_?0\b",
    r"\blag0\b",
    r"(?:_|\b)leak(?:_|\b)?",
)
DERIVED = r"_lag_?\d+|_roll|_mean|_std|_min|_max|_enc"


def structural_leaks(names: list[str], target: str) -> list[tuple[str, str]]:
    """(column, why) of columns whose names tell of the future or, without a mark of a feature made from the past, of the target."""
    future, made = re.compile("|".join(FUTURE)), re.compile(DERIVED)
    whys = ((n, "names the future" if future.search(n.lower()) else "holds the target's name" if target.lower() in n.lower() != target.lower() and not made.search(n.lower()) else None) for n in names)
    return [(n, why) for n, why in whys if why]


def leakage_risks(columns: list[str], target: str, time_in_val_before_train_end: bool, groups_overlap: bool) -> list[str]:
    """What a reader should look at before trusting a split."""
    out = ["val has periods inside train"] if time_in_val_before_train_end else []
    out += ["groups are in train and val"] if groups_overlap else []
    out += [f"{c}: {why}" for c, why in structural_leaks(columns, target)]
    return out + [f"{c} is named as an id" for c in columns if re.search(r"(^|_)id$", c.lower())]
