"""Joins whose keys may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1024


def lookup(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join with a table of one row a key that knows how many of ``total`` rows its key has (``count``).

    Fewer than HOT keys can hold more than 1 / HOT of the rows each: those are broadcast, so that their rows stay where they
    are; all other rows are joined by shuffle. Null keys match nothing.
    """
    least = total // HOT
    hot = F.broadcast(facts.where(F.col(count) > least).drop(count))
    rest = facts.where(F.col(count) <= least).drop(count)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys, "left"))
