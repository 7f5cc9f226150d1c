"""Column expressions shared by the operators: all are Spark built-ins, so they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def hash_fold(key: Column | str, k: int, seed: int = 42) -> Column:
    """A fold number 0 .. k-1 that depends on the key alone."""
    c = F.col(key) if isinstance(key, str) else key
    return (F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long") % k).cast("int")


def harmonics(t: Column, period: float, name: str, orders: int = 1) -> list[Column]:
    """Sine and cosine of t's place in a cycle."""
    out = []
    for h in range(1, orders + 1):
        angle = F.pmod(t, F.lit(period)) * (2 * h) * F.pi() / period
        tag = name if h == 1 else f"{name}{h}"
        out += [F.sin(angle).alias(f"{tag}_sin"), F.cos(angle).alias(f"{tag}_cos")]
    return out


def ratio(a: str, b: str, eps: float = 1e-9) -> Column:
    """a / (|b| + eps): never divides by zero."""
    return F.col(a) / (F.abs(F.col(b)) + eps)


def log1p_floor(c: Column | str) -> Column:
    """ln(1 + max(c, 0)); null for null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def entropy(columns: list[str]) -> Column:
    """Shannon entropy of a row's non-negative shares; a row without mass counts as uniform."""
    parts = [F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in columns]
    total = reduce(lambda a, b: a + b, parts)
    shares = [F.when(total > 0, p / F.when(total > 0, total)).otherwise(1.0 / len(parts)) for p in parts]
    return -reduce(lambda a, b: a + b, [s * F.ln(s + 1e-9) for s in shares])


def ordered(groups: list[str], axis: str) -> Window:
    """The window of a panel: one group's rows along the axis. A series without groups has one constant group."""
    return Window.partitionBy(*(groups or [F.lit(1)])).orderBy(axis)


def not_nan(c: str) -> Column:
    """The column with NaN as null, since aggregates skip nulls only."""
    return F.nanvl(F.col(c), F.lit(None).cast("double"))
