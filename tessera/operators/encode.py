"""Fold-fit imputers, scalers and target encoders. State is a small table; which rows it came from is a column, never a position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.running import exact_medians

NONE = "__NA__"


def fit_fill(df: DataFrame, columns: list[str], how: str = "median") -> DataFrame:
    """One row of medians or means; null for a column without values."""
    if how == "mean":
        return df.agg(*(F.avg(c).alias(c) for c in columns))
    if how != "median":
        raise ValueError(f"{how} is neither median nor mean")
    return exact_medians(df, columns).agg(*(F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in columns))


def impute(df: DataFrame, fill: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by a fill row's values."""
    out = df.crossJoin(F.broadcast(fill.select(*(F.col(c).alias(f"_f_{c}") for c in columns))))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_f_{c}")) for c in columns}).drop(*(f"_f_{c}" for c in columns))


def fit_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and sample deviations; a deviation of 0 or null counts as 1."""
    return df.agg(*(F.avg(c).alias(f"{c}_mean") for c in columns), *(F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_std") for c in columns))


def scale(df: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    out = df.crossJoin(F.broadcast(state))
    return out.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).drop(*state.columns)


def _category(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(NONE))


def target_encode(train: DataFrame, rows: DataFrame, category: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """Adds {category}_te to rows: (n * mean + s * global) / (n + s); an unseen category has the global mean."""
    mu = train.agg(F.avg(target).alias("_mu"))
    stats = train.groupBy(_category(category).alias("_c")).agg(F.count(target).alias("_n"), F.sum(target).alias("_s"))
    out = rows.withColumn("_c", _category(category)).join(stats, "_c", "left").crossJoin(F.broadcast(mu))
    te = (F.coalesce("_s", F.lit(0.0)) + smoothing * F.col("_mu")) / (F.coalesce("_n", F.lit(0)) + smoothing)
    return out.withColumn(f"{category}_te", te).drop("_c", "_n", "_s", "_mu")


def target_encode_oof(train: DataFrame, category: str, target: str, fold: str = "fold_id", smoothing: float = 10.0) -> DataFrame:
    """Adds {category}_te to training rows without their own fold: totals less the fold's, one aggregate by (category, fold)."""
    rows = train.withColumn("_c", _category(category))
    own = rows.groupBy("_c", fold).agg(F.count(target).alias("_n"), F.coalesce(F.sum(target), F.lit(0.0)).alias("_s"))
    w = Window.partitionBy("_c")
    rest = own.select("_c", fold, (F.sum("_n").over(w) - F.col("_n")).alias("_n"), (F.sum("_s").over(w) - F.col("_s")).alias("_s"))
    mu = train.agg(F.avg(target).alias("_mu"))
    te = F.when(F.col("_n") > 0, (F.col("_s") + smoothing * F.col("_mu")) / (F.col("_n") + smoothing)).otherwise(F.col("_mu"))
    return rows.join(rest, ["_c", fold]).crossJoin(F.broadcast(mu)).withColumn(f"{category}_te", te).drop("_c", "_n", "_s", "_mu")


def relational_stats(train: DataFrame, group: str, target: str, by: list[str] | None = None, top: int = 3) -> DataFrame:
    """group, group_mean, dense rank (highest first), mean of the other groups and gap to the top groups' mean, for each ``by``."""
    by = by or []
    g = train.groupBy(*by, group).agg(F.avg(target).alias("group_mean"))
    every = Window.partitionBy(*(by or [F.lit(1)]))
    ranked = every.orderBy(F.desc("group_mean"))
    tops = every.orderBy(F.desc("group_mean"), group)
    g = g.withColumns({"group_rank": F.dense_rank().over(ranked), "_k": F.row_number().over(tops), "_all": F.sum("group_mean").over(every), "_n": F.count("*").over(every)})
    peer = F.coalesce(F.try_divide(F.col("_all") - F.col("group_mean"), F.col("_n") - 1), F.col("group_mean"))
    best = F.avg(F.when(F.col("_k") <= top, F.col("group_mean"))).over(every)
    return g.select(*by, group, "group_mean", "group_rank", peer.alias("peer_mean"), (F.col("group_mean") - best).alias("gap_to_top"))


def relational_encode(train: DataFrame, rows: DataFrame, group: str, target: str) -> DataFrame:
    """Adds the statistics to rows; an unseen group has the mean rank, the global mean and a gap of 0."""
    stats = relational_stats(train, group, target)
    mean = stats.agg(F.avg("group_rank").alias("_r"), F.avg("group_mean").alias("_m"))
    out = rows.join(stats, group, "left").crossJoin(F.broadcast(mean))
    return out.select(*rows.columns, F.coalesce(F.col("group_rank").cast("double"), "_r").alias("group_rank"), F.coalesce("peer_mean", "_m").alias("peer_mean"), F.coalesce("gap_to_top", F.lit(0.0)).alias("gap_to_top"))


def relational_encode_oof(train: DataFrame, group: str, target: str, folds: int, fold: str = "fold_id") -> DataFrame:
    """Adds the statistics to training rows, those of a fold from all other folds: ranks can't be subtracted, so sums by (group, fold) are,
    and ranks are taken for each fold left out."""
    own = train.groupBy(group, fold).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    total = own.groupBy(group).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    grid = total.select(group, "_ts", "_tn", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias(fold))
    rest = grid.join(own, [group, fold], "left").select(group, fold, (F.col("_ts") - F.coalesce("_s", F.lit(0.0))).alias("_s"), (F.col("_tn") - F.coalesce("_n", F.lit(0))).alias("_n"))
    means = rest.where("_n > 0").select(group, fold, (F.col("_s") / F.col("_n")).alias("_mean"))
    stats = relational_stats(means, group, "_mean", [fold])
    mean = stats.groupBy(fold).agg(F.avg("group_rank").alias("_r"), F.avg("group_mean").alias("_m"))
    out = train.join(stats, [group, fold], "left").join(F.broadcast(mean), fold, "left")
    return out.select(*train.columns, F.coalesce(F.col("group_rank").cast("double"), "_r").alias("group_rank"), F.coalesce("peer_mean", "_m").alias("peer_mean"), F.coalesce("gap_to_top", F.lit(0.0)).alias("gap_to_top"))


def qualifies(train: DataFrame, group: str, target: str, least: int = 20, skew: float = 1.0) -> DataFrame:
    """n_groups, skewness of the group means, and whether the relational encoder is worth its columns."""
    g = train.groupBy(group).agg(F.avg(target).alias("m"))
    return g.agg(F.count("*").alias("n_groups"), F.skewness("m").alias("skewness")).withColumn("qualifies", (F.col("n_groups") >= least) & (F.coalesce("skewness", F.lit(0.0)) >= skew))
