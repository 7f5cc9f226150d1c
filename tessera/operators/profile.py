"""Column profiles, from the table of value counts; shares and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.counts import Counts, counted


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def column_profile(data: DataFrame | Counts) -> DataFrame:
    """column, dtype, n_unique, n_null, null_pct and, of numeric columns, min, max, mean, std, median."""
    return counted(data).profile()


def top_values(data: DataFrame | Counts, column: str, n: int = 5) -> DataFrame:
    """The n most frequent values; equal counts by value."""
    return counted(data, [column]).top(column, n)


def class_balance(df: DataFrame, target: str, least: float = 0.10) -> DataFrame:
    """n and share of each class, and whether the rarest falls below ``least``."""
    from pyspark.sql import Window

    w = Window.partitionBy()  # over classes, not rows
    counts = df.groupBy(F.col(target).alias("label")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(w)
    return counts.select("label", "n", share.alias("share")).withColumn("imbalanced", F.min("share").over(w) < least)


def overall_missingness(df: DataFrame) -> DataFrame:
    """Mean of the columns' null percentages."""
    parts = [F.round(F.try_divide(100.0 * F.count_if(F.col(c).isNull()), F.count("*")), 2) for c in df.columns]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("null_pct")).agg(F.avg("null_pct").alias("missing_pct"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts of equal-width bins between the column's least and largest value, which falls in the last bin."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    one = df.select(x.alias("x")).where("x is not null").crossJoin(F.broadcast(ends))
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1))
    return one.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
