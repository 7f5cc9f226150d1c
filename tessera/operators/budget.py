"""Which wide feature families a table can bear: columns, cells and memory, from the optimizer's own estimate of the table.

Base families are always built. The others are admitted by gain for each column they add, while the budget lasts, and a refusal says what it would have
exceeded. So a table that is small against the budget gets all of them, and one that is large keeps those that are worth most.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import entropy, ratio
from tessera.operators import features
from tessera.operators.profile import numeric_columns

# fixed values
MOST_COLUMNS, MOST_CELLS = 1000, 2e9
MOST_RATIOS = 20
CELL = 8  # bytes of a number


@dataclass(frozen=True)
class Size:
    """Estimated rows and bytes of a table."""

    rows: int
    bytes: int


def estimate(df: DataFrame) -> Size:
    """What the optimizer knows of a table: its bytes, and its rows from them where they were never counted. Nothing is run."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    size = int(str(stats.sizeInBytes()))
    if stats.rowCount().isDefined():
        return Size(int(str(stats.rowCount().get())), size)
    width = sum({"string": 20, "double": 8, "bigint": 8, "int": 4, "float": 4, "date": 4, "boolean": 1}.get(kind, 8) for _, kind in df.dtypes) + 8
    return Size(max(1, size // width), size)


def executor_memory(df: DataFrame) -> int:
    """Bytes of storage memory that the executors have free."""
    values, free = df.sparkSession.sparkContext._jsc.sc().getExecutorMemoryStatus().valuesIterator(), 0
    while values.hasNext():
        free += int(values.next()._2())
    return free


@dataclass(frozen=True)
class Budget:
    """The most added columns, added cells and, where it is given, bytes of added cells."""

    columns: int = MOST_COLUMNS
    cells: float = MOST_CELLS
    memory: int | None = None


@dataclass
class Families:
    """Families in the order they were asked for: admitted columns, and why others were refused."""

    admitted: dict[str, list[Column]] = field(default_factory=dict)
    refused: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[Column]:
        return [c for cols in self.admitted.values() for c in cols]

    def table(self, spark) -> DataFrame:
        """family, n_columns, refused."""
        rows = [(f, len(c), None) for f, c in self.admitted.items()] + [(f, 0, why) for f, why in self.refused.items()]
        return spark.createDataFrame(rows, "family string, n_columns int, refused string")


def admit(size: Size, base: dict[str, list[Column]], wide: dict[str, list[Column]], gain: dict[str, float] | None = None, budget: Budget | None = None) -> Families:
    """Base families and those of ``wide`` that fit: the greatest gain a column first (1 a family where it isn't known), of equals by name."""
    budget, gain, out = budget or Budget(), gain or {}, Families(dict(base))
    added, kept = 0, set()
    for f in sorted(wide, key=lambda f: (-gain.get(f, 1.0) / max(1, len(wide[f])), f)):
        n = added + len(wide[f])
        if n > budget.columns:
            out.refused[f] = f"{n} added columns > {budget.columns}"
        elif n * size.rows > budget.cells:
            out.refused[f] = f"{n * size.rows} added cells > {budget.cells:.0f}"
        elif budget.memory is not None and n * size.rows * CELL > budget.memory:
            out.refused[f] = f"{n * size.rows * CELL} added bytes > {budget.memory}"
        else:
            added = n
            kept.add(f)
    out.admitted |= {f: cols for f, cols in wide.items() if f in kept}
    return out


def panel_features(df: DataFrame, groups: list[str], axis: str, target: str, covariates: list[str] | None = None, lags: tuple[int, ...] = (1, 2, 3, 4), widths: tuple[int, ...] = (4, 8), budget: Budget | None = None, gain: dict[str, float] | None = None) -> tuple[DataFrame, Families]:
    """(the panel with the features of the admitted families, the families): lags, rolling statistics and covariate lags are the base; extended rolls, ratios and entropies are wide."""
    names = covariates if covariates is not None else [c for c in numeric_columns(df) if c not in (*groups, axis, target)]
    base = {"lags": features.lags(target, groups, axis, list(lags)), "rolls": features.rolls(target, groups, axis, list(widths)), "cov_lags": features.covariate_dynamics(names, groups, axis)}
    own = Window.partitionBy(*(groups or [F.lit(1)]))
    wide: dict[str, list[Column]] = {
        "cov_rolls_ext": [c for i, c in enumerate(features.covariate_dynamics(names, groups, axis, extended=True)) if i % 7 > 2],  # behind the three of cov_lags
        "cov_ratios": [ratio(a, b).alias(f"{a}_per_{b}") for a, b in combinations(names, 2)][:MOST_RATIOS],
        "cov_group_stats": [c for n in names for c in (F.avg(n).over(own).alias(f"{n}_group_mean"), F.stddev_samp(n).over(own).alias(f"{n}_group_std"), (F.col(n) - F.avg(n).over(own)).alias(f"{n}_group_dev"))],
        "cov_entropy": [entropy(names).alias("cov_entropy")] if len(names) > 1 else [],
    }
    wide = {f: c for f, c in wide.items() if c}
    budget, size = budget or Budget(memory=executor_memory(df)), estimate(df)
    found = admit(size, base, wide, gain, budget)
    if found.refused:  # the estimate is an upper bound, far off behind joins: a family is refused for rows that were counted
        rows = df.count()
        found = admit(Size(rows, size.bytes), base, wide, gain, budget)
    return df.select("*", *found.columns), found
