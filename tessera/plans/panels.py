"""The panels that the queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import ordered

DAILY_SQL = "daily as (select event_type, cast(ts as date) as day, sum(value) as y, count(*) as n from events group by 1, 2)"
DAILY_T_SQL = DAILY_SQL + ", panel as (select event_type, day, y, n, (dense_rank() over (order by day) - 1)::int as t from daily)"
MONTHLY_SQL = "monthly as (select l_suppkey as g, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::int as t, sum(l_quantity) as y, avg(l_discount) as d, avg(l_tax) as x from lineitem group by 1, 2)"
PRED_SQL = MONTHLY_SQL + ", pred as (select * from (select g, t, y, lag(y) over (partition by g order by t) as p, (t % 5)::int as fold_id from monthly) where p is not null)"


def daily(t) -> DataFrame:
    """Events by type and day: y, n."""
    return t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"), F.count("*").alias("n"))


def daily_ranked(t) -> DataFrame:
    """daily() with the day's rank t from 0."""
    from tessera.operators.axis import attach_rank, period_rank

    d = daily(t)
    return attach_rank(d, period_rank(d, d, "day"), "day").withColumnRenamed("period_rank", "t")


def month_index(c: str):
    return ((F.year(c) - 1995) * 12 + F.month(c) - 1).alias("t")


def monthly(t) -> DataFrame:
    """Line items by supplier and month: y, d, x."""
    return t("lineitem").groupBy(F.col("l_suppkey").alias("g"), month_index("l_shipdate")).agg(F.sum("l_quantity").alias("y"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("x"))


def predicted(t) -> DataFrame:
    """monthly() with the group's value before as prediction p, and a fold."""
    m = monthly(t)
    return m.select("g", "t", "y", F.lag("y").over(ordered(["g"], "t")).alias("p"), F.pmod("t", F.lit(5)).alias("fold_id")).where("p is not null")


def half_away(x: Column, digits: int) -> Column:
    """Rounds as SQL's round() in DuckDB does: the scaled double to the nearest integer, halves away from zero. F.round() rounds the shortest decimal that names the double, so it
    differs where a value lies within a bit of a half."""
    v = F.abs(x) * 10.0**digits
    near = F.rint(v)
    return F.when(F.abs(x) < 1e300, F.signum(x) * (near + F.when(v - near == 0.5, 1.0).otherwise(0.0)) / 10.0**digits).otherwise(x)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*((half_away(F.col(c), digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))
