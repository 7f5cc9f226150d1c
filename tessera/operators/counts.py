"""How often each value of each column occurs: one table from which profiles, gates and roles are read.

The table (column, value, number, n) is made in one pass over a dataset and written once. Tasks count whole column batches at a time, so no row is multiplied by
the number of columns, neither before nor in the shuffle: what is sent is a task's distinct values with their counts. Distinct counts, nulls, frequent
values, medians, percentiles, means, shares of dates and id gates are then aggregates of that table.

``value`` is the value as text (null for null), ``number`` its double where the column is numeric; 0.0 and -0.0 are one value, and so are all NaN, which
count as unknown numbers. Columns of other types than text and numbers are counted by their text. An empty dataset has a table without rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.running import place_values, running_sums
from tessera.sources.shared import own_path

HELD = 1 << 18  # distinct values of a column that a task holds before it hands them on


def _counted(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[pa.Table]] = {c: [] for c in names}
    rows = dict.fromkeys(names, 0)

    def merged(c: str) -> pa.Table:
        every = pa.concat_tables(held[c])
        return every.group_by("v").aggregate([("n", "sum")]).rename_columns(["v", "n"])

    def out(c: str) -> Iterator[pa.RecordBatch]:
        table = merged(c).combine_chunks()
        v = table["v"].combine_chunks() if table.num_rows else pa.array([], table["v"].type)
        v = v if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks)
        numeric = not pa.types.is_string(v.type) and not pa.types.is_large_string(v.type)
        columns = [pa.array([c] * len(v), pa.string()), v.cast(pa.string()), v.cast(pa.float64(), safe=False) if numeric else pa.nulls(len(v), pa.float64()), pa.array(table["n"].to_numpy(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["column", "value", "number", "n"])

    for b in batches:
        for i, c in enumerate(names):
            found = pc.value_counts(b.column(i))
            held[c].append(pa.table({"v": found.field("values"), "n": found.field("counts")}))
            rows[c] += len(found)
            if rows[c] > HELD:
                held[c] = [merged(c)]
                rows[c] = held[c][0].num_rows
                if rows[c] > HELD // 2:
                    yield from out(c)
                    held[c], rows[c] = [], 0
    for c in names:
        if held[c]:
            yield from out(c)


@dataclass(frozen=True)
class Counts:
    """The table of a dataset's values, and the dataset's schema."""

    table: DataFrame
    schema: T.StructType

    @staticmethod
    def of(df: DataFrame, columns: list[str] | None = None) -> Counts:
        names = columns if columns is not None else df.columns
        kinds = T.StructType([df.schema[c] for c in names])

        def cell(f: T.StructField) -> Column:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.IntegralType):
                return c.cast("long")
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                return c.cast("double") + F.lit(0.0)
            return c.cast("string")

        cells = df.select(*(cell(f).alias(f"c{i}") for i, f in enumerate(kinds)))
        parts = cells.mapInArrow(lambda batches: _counted(names, batches), "column string, value string, number double, n long") if names else df.sparkSession.createDataFrame([], "column string, value string, number double, n long")
        table = parts.groupBy("column", "value").agg(F.max("number").alias("number"), F.sum("n").alias("n"))
        decimals = [f.name for f in kinds if isinstance(f.dataType, T.DecimalType)]
        if decimals:
            table = table.withColumn("number", F.when(F.col("column").isin(decimals), F.col("value").try_cast("double")).otherwise(F.col("number")))
        path = own_path(df.sparkSession, "counts")
        table.write.parquet(path)
        return Counts(df.sparkSession.read.schema(table.schema).parquet(path), kinds)

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def named(self, kind: type | tuple[type, ...]) -> list[str]:
        return [f.name for f in self.schema if isinstance(f.dataType, kind)]

    @property
    def numeric(self) -> list[str]:
        return self.named(T.NumericType)

    @property
    def whole(self) -> list[str]:
        return self.named(T.IntegralType)

    def only(self, columns: list[str]) -> Counts:
        """The counts of some of the columns."""
        return Counts(self.table.where(F.col("column").isin(columns)), T.StructType([f for f in self.schema if f.name in columns]))

    def _listed(self, facts: DataFrame) -> DataFrame:
        """A row for each column, in the schema's order of names, whether or not it has values."""
        every = self.table.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in self.schema], "column string, dtype string")
        return F.broadcast(every).join(facts, "column", "left")

    def facts(self) -> DataFrame:
        """column, dtype, n_rows, n_unique, n_null, null_pct, contiguous (an integer column whose values are a run)."""
        known = F.col("value").isNotNull()
        run = F.max(F.when(known, F.col("value").try_cast("long"))) - F.min(F.when(known, F.col("value").try_cast("long"))) + 1
        sums = self.table.groupBy("column").agg(F.sum("n").alias("n_rows"), F.count("value").alias("n_unique"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"), run.alias("run"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        contiguous = F.coalesce(F.col("column").isin(self.whole) & (F.col("run") == F.col("n_unique")), F.lit(False)).alias("contiguous")
        return self._listed(sums).select("column", "dtype", zero("n_rows"), zero("n_unique"), zero("n_null"), F.round(F.try_divide(100.0 * F.col("n_null"), F.col("n_rows")), 2).alias("null_pct"), contiguous)

    def numbers(self) -> DataFrame:
        """column, number, n of known numbers."""
        return self.table.where(F.col("column").isin(self.numeric) & F.col("number").isNotNull() & ~F.isnan("number")).select("column", "number", "n")

    def moments(self) -> DataFrame:
        """column, min, max, mean, std (of a sample): the mean first, then squares about it, so that far-off values keep their digits."""
        x = self.numbers()
        first = x.groupBy("column").agg(F.min("number").alias("min"), F.max("number").alias("max"), F.sum("n").alias("_n"), (F.sum(F.col("number") * F.col("n")) / F.sum("n")).alias("mean"))
        about = x.join(F.broadcast(first.select("column", "mean")), "column").groupBy("column").agg(F.sum((F.col("number") - F.col("mean")) ** 2 * F.col("n")).alias("_s"))
        return first.join(F.broadcast(about), "column").select("column", "min", "max", "mean", F.sqrt(F.try_divide(F.col("_s"), F.col("_n") - 1)).alias("std"))

    def percentiles(self, at: dict[str, float]) -> DataFrame:
        """column and its exact percentiles, linear between neighbours, by name."""
        run = running_sums(self.numbers().withColumnRenamed("number", "v"), "v", ["n"], ["column"])
        return run.groupBy("column").agg(*place_values(at))

    def medians(self) -> DataFrame:
        return self.percentiles({"median": 0.5})

    def profile(self) -> DataFrame:
        """column, dtype, n_unique, n_null, null_pct and, of numeric columns, min, max, mean, std, median."""
        out = self.facts().select("column", "dtype", "n_unique", "n_null", "null_pct")
        return out.join(F.broadcast(self.moments()), "column", "left").join(F.broadcast(self.medians()), "column", "left")

    def top(self, column: str, n: int = 5) -> DataFrame:
        """value, n of the most frequent values; equal counts by value."""
        kind = self.schema[column].dataType
        value = F.col("value").cast(kind).alias("value")
        return self.table.where(F.col("column") == column).select(value, "n").orderBy(F.desc("n"), "value").limit(n)

    def parse_rates(self, columns: list[str] | None = None) -> DataFrame:
        """column, dates, numbers: shares of the known values that read as a timestamp and as a number."""
        seen = self.table.where(F.col("value").isNotNull() & F.col("column").isin(columns if columns is not None else self.columns))
        share = lambda c: (F.sum(F.when(c.isNotNull(), F.col("n")).otherwise(0)) / F.sum("n"))
        return seen.groupBy("column").agg(share(F.try_to_timestamp("value")).alias("dates"), share(F.col("value").try_cast("double")).alias("numbers"))


def counted(data: DataFrame | Counts, columns: list[str] | None = None) -> Counts:
    """The counts of a dataset; of counts, those of the columns."""
    if isinstance(data, Counts):
        return data if columns is None else data.only(columns)
    return Counts.of(data, columns)
