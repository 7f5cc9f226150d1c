"""Feature families of panels and cross-sections.

Every window of a panel has the same partitioning and order, so all of them plan as one exchange and one sort. Frames end
before the current row wherever they read the target.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expr import entropy, harmonics, log1p_floor, ordered, ratio
from tessera.operators.running import running_sums
from tessera.operators.submit import numbered


def depths(min_periods: int) -> dict[str, list[int]]:
    """Lags and rolling widths that the shortest group has history for."""
    lags = [1, 2, 3, 4] + [k for k in (8, 12, 26) if min_periods >= k + 4] + ([52] if min_periods >= 60 else [])
    lags += [k for k in (24, 48, 168) if min_periods >= k + 4]
    return {"lags": sorted(set(lags)), "rolls": [4, 8] + [w for w in (13, 26) if min_periods >= w + 4]}


def min_periods(df: DataFrame, groups: list[str]) -> int:
    """Length of the shortest group."""
    return df.groupBy(*groups).count().agg(F.min("count")).first()[0] or 0


def lags(target: str, groups: list[str], axis: str, steps: list[int]) -> list[Column]:
    w = ordered(groups, axis)
    return [F.lag(target, k).over(w).alias(f"lag_{k}") for k in steps]


def rolls(target: str, groups: list[str], axis: str, widths: list[int], name: str = "roll") -> list[Column]:
    """Mean and sample deviation of the rows before; the deviation of a single row is null."""
    out = []
    for n in widths:
        w = ordered(groups, axis).rowsBetween(-n, -1)
        out += [F.avg(target).over(w).alias(f"{name}_mean_{n}"), F.stddev_samp(target).over(w).alias(f"{name}_std_{n}")]
    return out


def deviation(column: str, frame: Window) -> Column:
    """Sample deviation of a short frame by the update that DuckDB makes: m2 + (x - new mean) * (x - mean); stddev_samp() rounds in other places, which shows at halves. Null below two values."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1.0)
        return F.struct((s["n"] + 1.0).alias("n"), mean.alias("mean"), (s["m2"] + (x - mean) * (x - s["mean"])).alias("m2"))

    values = F.collect_list(F.col(column).cast("double")).over(frame)
    return F.aggregate(values, start, step, lambda s: F.when(s["n"] > 1, F.sqrt(s["m2"] / F.greatest(s["n"] - 1, F.lit(1.0)))))


def covariate_dynamics(columns: list[str], groups: list[str], axis: str, extended: bool = False) -> list[Column]:
    """Lag 1, difference and mean of the four rows before; extended: means of 8 and 13, deviations of 4 and 8."""
    w = ordered(groups, axis)
    out = []
    for c in columns:
        out += [F.lag(c).over(w).alias(f"{c}_lag1"), (F.col(c) - F.lag(c).over(w)).alias(f"{c}_delta"), F.avg(c).over(w.rowsBetween(-4, -1)).alias(f"{c}_roll4")]
        if extended:
            out += [F.avg(c).over(w.rowsBetween(-n, -1)).alias(f"{c}_roll{n}") for n in (8, 13)]
            out += [deviation(c, w.rowsBetween(-n, -1)).alias(f"{c}_std{n}") for n in (4, 8)]
    return out


def rolling_z(column: str, groups: list[str], axis: str, width: int = 4) -> Column:
    """Distance from the mean of the last rows, this one included, in their deviations."""
    w = ordered(groups, axis).rowsBetween(-(width - 1), 0)
    return F.try_divide(F.col(column) - F.avg(column).over(w), F.nullif(F.stddev_samp(column).over(w), F.lit(0.0))).alias(f"{column}_z")


def ecdf(train: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Adds ecdf: the share of train's values at or below each row's. Values are counted first, and sums run over slices of them."""
    both = train.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).unionByName(rows.select(F.col(column).alias("v")).distinct().withColumn("n", F.lit(0)))
    counts = both.where("v is not null").groupBy("v").agg(F.sum("n").alias("n"))
    table = running_sums(counts, "v", ["n"]).select(F.col("v").alias(column), (F.col("cum_n") / F.col("all_n")).alias("ecdf"))
    return rows.join(table, column, "left")


def category_codes(train: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Adds {column}_code: the place of the value among all values, from 0; -1 for null."""
    values = train.select(column).union(rows.select(column)).where(F.col(column).isNotNull()).distinct()
    codes = numbered(values, [column]).select(column, F.col("row_id").cast("int").alias("_code"))
    return rows.join(codes, column, "left").withColumn(f"{column}_code", F.coalesce("_code", F.lit(-1))).drop("_code")


def annual(axis: str, period: float = 52, orders: int = 2) -> list[Column]:
    return harmonics(F.col(axis), period, "annual", orders)


def relative_time(df: DataFrame, axis: str) -> DataFrame:
    """Adds relative_time: 0 at the first period, 1 at the last."""
    ends = df.agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn("relative_time", (F.col(axis) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))).drop("_lo", "_hi")


def calendar(time: str, grain: str) -> list[Column]:
    """Cyclic hour, weekday (Monday 0), month and ISO week, as the grain allows; month's quarter for monthly rows."""
    t = F.col(time)
    out = []
    if grain == "hourly":
        out += harmonics(F.hour(t), 24, "hour", 2)
    if grain in ("hourly", "daily"):
        out += harmonics(F.weekday(t), 7, "dow")
    if grain in ("daily", "monthly"):
        out += harmonics(F.month(t), 12, "month")
    if grain == "daily":
        out += harmonics(F.weekofyear(t), 52, "week")
    if grain == "monthly":
        out.append(F.quarter(t).alias("quarter"))
    return out


def time_derived(axis: str, period: int = 52) -> list[Column]:
    place = F.pmod(F.col(axis), F.lit(period))
    return [place.alias("cycle_pos"), F.floor(place / 13).cast("int").alias("cycle_quarter"), F.floor(place / 4).cast("int").alias("cycle_month"), F.col(axis).alias("trend")]


def baselines(train: DataFrame, groups: list[str], part: Column, target: str, name: str) -> DataFrame:
    """Mean and sample deviation of the target by group and part (hour, weekday ...). Fit on a fold's training rows."""
    return train.groupBy(*groups, part.alias(name)).agg(F.avg(target).alias(f"{name}_mean"), F.stddev_samp(target).alias(f"{name}_std"))


def ratio_pairs(df: DataFrame, columns: list[str], least: float = 0.5, most: int = 20, correlate_up_to: int = 30) -> list[tuple[str, str]]:
    """Pairs that share a name's prefix, then pairs with |correlation| above ``least``; the first ``most``. One aggregate for all."""
    pairs = [p for p in combinations(columns, 2) if p[0].split("_")[0] == p[1].split("_")[0]]
    if len(columns) <= correlate_up_to and len(columns) > 1:
        complete = df.dropna(subset=columns)
        found = complete.agg(*(F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(combinations(columns, 2)))).first()
        pairs += [p for i, p in enumerate(combinations(columns, 2)) if found[i] is not None and abs(found[i]) > least and p not in pairs]
    return pairs[:most]


def ratios(pairs: list[tuple[str, str]]) -> list[Column]:
    return [ratio(a, b).alias(f"{a}_over_{b}") for a, b in pairs]


def interactions(numeric: list[str], binary: list[str], squares: bool = False, products: bool = False) -> list[Column]:
    """Numeric by binary and binary by binary products; optionally squares and all numeric products."""
    out = [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a in numeric for b in binary]
    out += [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in combinations(binary, 2)]
    out += [(F.col(c) * F.col(c)).alias(f"{c}_sq") for c in numeric if squares]
    return out + [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in combinations(numeric, 2) if products]


def thresholds(column: str, at_least: tuple[float, ...] = (), below: tuple[float, ...] = (), bucket: float | None = None) -> list[Column]:
    """0/1 flags and an optional bucket number; the marks come from the caller."""
    c = F.col(column)
    out = [(c >= v).cast("int").alias(f"{column}_ge_{str(v).replace('.', '_')}") for v in at_least]
    out += [(c < v).cast("int").alias(f"{column}_lt_{str(v).replace('.', '_')}") for v in below]
    return out + ([F.floor(c / bucket).alias(f"{column}_bucket")] if bucket else [])


def powers(column: str) -> list[Column]:
    c = F.col(column)
    return [(c * c * c).alias(f"{column}_cube"), F.when(c.isNotNull(), F.sqrt(F.greatest(c, F.lit(0.0)))).alias(f"{column}_sqrt"), log1p_floor(column).alias(f"{column}_log1p")]


def compound(a: str, b: str, scale: float = 100.0) -> list[Column]:
    x = F.col(a) / scale * F.col(b)
    return [x.alias(f"{a}_{b}_compound"), (x * x).alias(f"{a}_{b}_compound_sq")]


def prefix_entropy(columns: list[str], name: str) -> Column:
    return entropy(columns).alias(name)


def horizon(axis: str, train_max: Column) -> Column:
    """Steps past train's last period; 0 in train."""
    return F.greatest(F.col(axis) - train_max, F.lit(0)).alias("horizon")


def impute_cycle_lag(train: DataFrame, val: DataFrame, groups: list[str], axis: str, target: str, cycle: int, step: int) -> DataFrame:
    """Adds lag_{step} to val: train's mean at the group's place in the cycle ``step`` before, else the group's last known target."""
    place = F.pmod(F.col(axis), F.lit(cycle)).cast("int")
    means = train.groupBy(*groups, place.alias("_place")).agg(F.avg(target).alias("_mean"))
    last = train.where(F.col(target).isNotNull()).groupBy(*groups).agg(F.max_by(target, axis).alias("_last"))
    rows = val.withColumn("_place", F.pmod(F.col(axis) - step, F.lit(cycle)).cast("int"))
    out = rows.join(means, [*groups, "_place"], "left").join(last, groups, "left")
    return out.withColumn(f"lag_{step}", F.coalesce("_mean", "_last")).drop("_place", "_mean", "_last")


def impute_rolls(df: DataFrame, last: DataFrame, groups: list[str], means: list[str], stds: list[str]) -> DataFrame:
    """Unknown rolling means become the group's last known target, unknown deviations 0."""
    out = df.join(last, groups, "left")
    return out.withColumns({c: F.coalesce(c, "last_known") for c in means} | {c: F.coalesce(F.col(c), F.lit(0.0)) for c in stds}).drop("last_known")


def shift_aware(df: DataFrame, column: str, groups: list[str], axis: str) -> DataFrame:
    """Opt-in: global z-score, rolling z-score, deviation from the group's mean, and product with time."""
    own = Window.partitionBy(*groups)
    c = F.col(column)
    stats = df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    out = df.crossJoin(F.broadcast(stats))
    return out.select(*df.columns, F.try_divide(c - F.col("_m"), F.nullif(F.col("_s"), F.lit(0.0))).alias(f"{column}_global_z"), rolling_z(column, groups, axis), (c - F.avg(column).over(own)).alias(f"{column}_group_dev"), (c * F.col(axis)).alias(f"{column}_x_time"))


def contract(train: DataFrame, val: DataFrame, target: str, groups: list[str], exclude: tuple[str, ...] = (), most: int = 50) -> DataFrame:
    """What later stages do with each column that train and val share: impute (a null in either), scale (numbers), encode (groups and text of up to
    ``most`` values in train). The target and ``exclude`` are no features."""
    numbers = [f.name for f in train.schema if isinstance(f.dataType, T.NumericType)]
    names = [c for c in train.columns if c in val.columns and c != target and c not in exclude]
    both = train.select(*names).unionByName(val.select(*names))
    nulls = both.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in names)).alias("p")).select(F.inline("p"))
    texts = [c for c in names if c not in numbers]
    values = None
    if texts:
        cells = train.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in texts)))).where("v is not null")
        values = cells.distinct().groupBy("column").agg(F.count("*").alias("n_values"))
    out = nulls.join(F.broadcast(values), "column", "left") if values is not None else nulls.withColumn("n_values", F.lit(None).cast("long"))
    c = F.col("column")
    few = c.isin(*texts) & (F.coalesce("n_values", F.lit(0)) <= most) if texts else F.lit(False)
    return out.select("column", (F.col("n_null") > 0).alias("impute"), (c.isin(*numbers) & ~c.isin(*groups)).alias("scale"), (c.isin(*groups) | few).alias("encode"))
