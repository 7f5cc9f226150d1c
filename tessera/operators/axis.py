"""The period axis: ranks, horizons, cadence and codebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.submit import numbered


def period_rank(train: DataFrame, val: DataFrame, period: str) -> DataFrame:
    """period, period_rank: dense, from 0, over the periods of both. Only distinct periods are ordered."""
    both = train.select(period).union(val.select(period)).where(F.col(period).isNotNull()).distinct()
    return both.select(period, (F.dense_rank().over(Window.orderBy(period)) - 1).alias("period_rank"))


def attach_rank(df: DataFrame, ranks: DataFrame, period: str) -> DataFrame:
    """Adds period_rank; a period without a rank is an error."""
    missing = df.select(period).distinct().join(ranks, period, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"periods without a rank: {[r[0] for r in missing]}")
    return df.join(ranks, period)


def opaque_rank(train: DataFrame, val: DataFrame, period: str) -> DataFrame:
    """Ranks of ids without dates: train's in order, then val's new ones."""
    ids = train.select(period, F.lit(0).alias("new")).union(val.select(period, F.lit(1))).groupBy(period).agg(F.min("new").alias("new"))
    return ids.select(period, "new", (F.dense_rank().over(Window.orderBy("new", period)) - 1).alias("period_rank"))


def horizons(train: DataFrame, val: DataFrame, rank: str, most: int = 20) -> DataFrame:
    """The steps from train's last period to each of val's, and the gap to the first."""
    last = train.agg(F.max(rank).alias("last"))
    steps = val.select(rank).distinct().crossJoin(F.broadcast(last)).select((F.col(rank) - F.col("last")).alias("step")).where("step > 0")
    return steps.withColumn("gap", F.min("step").over(Window.partitionBy())).orderBy("step").limit(most)


def period_gaps(df: DataFrame, axis: str, groups: list[str] | None = None) -> DataFrame:
    """The distance of each distinct period from the one before it (of its group)."""
    groups = groups or []
    rows = df.select(*groups, axis).distinct()
    w = Window.partitionBy(*(groups or [F.lit(1)])).orderBy(axis)
    return rows.withColumn("gap", F.abs(F.col(axis) - F.lag(axis).over(w))).where("gap is not null")


def cadence(gaps: DataFrame) -> DataFrame:
    """median_gap, modal_gap, modal_share, variation (std / mean) and irregular (modal share < 0.6 or variation > 0.5)."""
    counts = gaps.groupBy("gap").agg(F.count("*").alias("n"))
    modal = counts.agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    stats = gaps.agg(F.median("gap").alias("median_gap"), F.mode("gap", True).alias("modal_gap"), F.try_divide(F.stddev_samp("gap"), F.avg("gap")).alias("variation"))
    out = stats.crossJoin(modal).select("median_gap", "modal_gap", (F.col("top") / F.col("all")).alias("modal_share"), "variation")
    return out.withColumn("irregular", (F.col("modal_share") < 0.60) | (F.coalesce("variation", F.lit(0.0)) > 0.50))


def granularity(median_hours: float, irregular: bool = False) -> str:
    """hourly, daily, weekly or monthly by the median step in hours; agnostic where an irregular cadence lies within 12 hours of a bound."""
    bounds = (2, 48, 216)
    if irregular and any(abs(median_hours - b) <= 12 for b in bounds):
        return "agnostic"
    return next((n for b, n in zip(bounds, ("hourly", "daily", "weekly"), strict=True) if median_hours < b), "monthly")


def codebook(spark, entries: dict[str, str]) -> DataFrame:
    """period_id, date from {id: date} or {date: id}; the side of which over 80 % read as dates is the date."""
    df = spark.createDataFrame(list(entries.items()), "a string, b string")
    rate = df.agg(*(F.avg(F.try_to_timestamp(F.col(c)).isNotNull().cast("double")) for c in "ab")).first()
    if len(entries) < 10 or max(rate) <= 0.8:
        raise ValueError("no codebook: it needs ten entries, and dates on one side")
    ids, dates = ("b", "a") if rate[0] > rate[1] else ("a", "b")
    return df.select(F.col(ids).alias("period_id"), F.try_to_timestamp(F.col(dates)).cast("date").alias("date"))


def codebook_ranks(train: DataFrame, val: DataFrame, book: DataFrame, period: str) -> DataFrame:
    """period, date, period_rank, in_train, in_val of every period of either side, in order of its date (of its id on one day), from 0. A period that the codebook
    doesn't map, or maps to no date, has neither date nor rank."""
    side = lambda df, t, v: df.select(F.col(period).cast("string").alias(period), F.lit(t).alias("t"), F.lit(v).alias("v"))
    seen = side(train, True, False).union(side(val, False, True)).where(F.col(period).isNotNull()).groupBy(period).agg(F.max("t").alias("in_train"), F.max("v").alias("in_val"))
    dated = seen.join(book.select(F.col("period_id").alias(period), "date").where("date is not null").dropDuplicates([period]), period, "left")
    ranked = numbered(dated.where("date is not null"), ["date", period]).withColumnRenamed("row_id", "period_rank")
    rest = dated.where("date is null").withColumn("period_rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(period, "date", "period_rank", "in_train", "in_val")


def unmapped(ranks: DataFrame, period: str) -> tuple[DataFrame, DataFrame]:
    """The periods of train, and those of val, that have no rank."""
    none = ranks.where("period_rank is null")
    return none.where("in_train").select(period), none.where("in_val").select(period)


def codebook_features(df: DataFrame, book: DataFrame, key: str) -> DataFrame:
    """month (median where unmapped), quarter and is_quarter_start of each row's period."""
    joined = df.join(book.withColumnRenamed("period_id", key), key, "left")
    middle = joined.select(F.month("date").alias("m")).agg(F.median("m").alias("middle"))
    out = joined.crossJoin(F.broadcast(middle))
    month = F.coalesce(F.month("date").cast("double"), F.col("middle"))
    return out.select(*df.columns, month.alias("month"), F.quarter("date").alias("quarter"), F.coalesce((F.pmod(F.month("date") - 1, F.lit(3)) == 0) & (F.dayofmonth("date") == 1), F.lit(False)).alias("is_quarter_start"))


def generic_ranks(train: DataFrame, val: DataFrame, period: str, least: float = 0.9) -> DataFrame | None:
    """period, period_rank of periods as text or numbers: in order of time where nine tenths read as dates, else in order of size where as many read
    as numbers, else None. A period that reads as neither comes last, in order of its text."""
    both = train.select(period).union(val.select(period)).where(F.col(period).isNotNull()).distinct()
    text = F.col(period).cast("string")
    read = both.select(period, F.try_to_timestamp(text).cast("double").alias("date"), text.try_cast("double").alias("number"))
    dates, numbers = read.agg(F.avg(F.col("date").isNotNull().cast("double")), F.avg(F.col("number").isNotNull().cast("double"))).first()
    if dict(both.dtypes)[period] not in ("string", "date") and not dict(both.dtypes)[period].startswith("timestamp"):
        dates = 0.0  # a number is no date
    order = "date" if (dates or 0) >= least else "number" if (numbers or 0) >= least else None
    if order is None:
        return None
    return read.select(period, (F.dense_rank().over(Window.orderBy(F.col(order).asc_nulls_last(), F.when(F.col(order).isNull(), text))) - 1).alias("period_rank"))
