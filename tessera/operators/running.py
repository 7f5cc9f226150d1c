"""Running sums and exact quantiles over values of any number: no task holds more than a slice of the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256


def place(bounds: Column, key: Column, n: int) -> Column:
    """How many of the n sorted bounds (an array column) are at most the key: a binary search."""
    steps = max(1, n).bit_length()
    tries = F.array(*[F.lit(1 << i) for i in range(steps - 1, -1, -1)])
    return F.aggregate(tries, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def running_sums(df: DataFrame, order: str, sums: list[str], keys: list[str] | None = None, slices: int = SLICES, few: bool = False) -> DataFrame:
    """Adds cum_{c} (through this value) and all_{c} (of the key) for each c of ``sums``; df has one row a key and value.

    The values of a key are cut into slices of about equal length by approximate quantiles. Sums run inside the slices and over the slices'
    totals, of which there are ``slices`` a key. Where the cuts fall doesn't change a result. ``few``: keys are as few as columns, so bounds and totals are broadcast
    and the rows of a key never lie in one task.
    """
    keys = keys or []
    at = [i / slices for i in range(1, slices)]
    small = F.broadcast if few or not keys else lambda table: table
    own = keys or [F.lit(0).alias("_one")]
    bounds = df.groupBy(*own).agg(F.percentile_approx(order, at, 2000).alias("_bounds"))
    cut = (df.join(small(bounds), keys) if keys else df.crossJoin(F.broadcast(bounds.drop("_one")))).withColumn("_slice", place(F.col("_bounds"), F.col(order), slices - 1)).drop("_bounds")
    totals = cut.groupBy(*keys, "_slice").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    across = Window.partitionBy(*(keys or [F.lit(0)]))
    before = across.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_slice", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums), *(F.sum(f"_t_{c}").over(across).alias(f"all_{c}") for c in sums))
    within = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({f"cum_{c}": F.sum(c).over(within) for c in sums}).join(small(totals), [*keys, "_slice"])
    return out.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_b_{c}") for c in sums}).drop("_slice", *(f"_b_{c}" for c in sums))


def place_values(at: dict[str, float], value: str = "v") -> list[Column]:
    """Aggregates of running sums of counts ``n``: the exact percentiles by name, linear between neighbours."""
    cells = []
    for name, p in at.items():
        rank = (F.col("all_n") - 1) * p
        low, high = _at_rank(F.floor(rank), value), _at_rank(F.ceil(rank), value)
        cells.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(name))
    return cells


def _at_rank(rank: Column, value: str) -> Column:
    return F.max(F.when((F.col("cum_n") > rank) & (F.col("cum_n") - F.col("n") <= rank), F.col(value)))


def exact_percentiles(df: DataFrame, column: str, at: dict[str, float]) -> DataFrame:
    """One row of exact percentiles (linear between neighbours) by name; null for a column without values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    return running_sums(counts, "v", ["n"]).agg(*place_values(at))


def exact_medians(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by,) column, median of each column with values, from one pass: values are counted first, and sums run over slices of them. ``by``: a few keys, like folds."""
    keys = [*(by or []), "column"]
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    counts = df.select(*(by or []), F.inline(F.array(*pairs))).where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("n"))
    return running_sums(counts, "v", ["n"], keys, few=True).groupBy(*keys).agg(*place_values({"median": 0.5}))
