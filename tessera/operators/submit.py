"""Predictions into a template and back again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import own_path


def submission(template: DataFrame, pred: DataFrame, keys: list[str], target: str, prediction: str) -> DataFrame:
    """The template with its target from the predictions by composite key. Repeated keys among the predictions are an error, since they would add rows."""
    if not pred.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("predictions repeat a key")
    return template.drop(target).join(pred.select(*keys, F.col(prediction).alias(target)), keys, "left")


def repair(df: DataFrame, target: str, mean: float, floor: float | None = 0.0) -> DataFrame:
    """Unknown predictions become the mean, those below the floor the floor."""
    c = F.coalesce(F.col(target), F.lit(mean))
    return df.withColumn(target, c if floor is None else F.greatest(c, F.lit(floor)))


def round_trip(sub: DataFrame, pred: DataFrame, keys: list[str], target: str, prediction: str, atol: float = 1e-6) -> DataFrame:
    """n_rows, n_unmatched, n_different, passed: the audit comes before any repair."""
    back = sub.join(pred.select(*keys, F.col(prediction).alias("_p"), F.lit(1).alias("_hit")), keys, "left")
    off = F.col("_hit").isNotNull() & (F.coalesce(F.abs(F.col(target) - F.col("_p")), F.lit(0.0)) > atol)
    g = back.agg(F.count("*").alias("n_rows"), F.count_if(F.col("_hit").isNull()).alias("n_unmatched"), F.count_if(off).alias("n_different"))
    return g.withColumn("passed", (F.col("n_unmatched") == 0) & (F.col("n_different") == 0))


def stats(sub: DataFrame, target: str) -> DataFrame:
    t = F.col(target)
    return sub.agg(F.min(t).alias("min"), F.max(t).alias("max"), F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"), F.count_if(t.isNull()).alias("n_null"), F.count_if(t < 0).alias("n_negative"))


def unseen_labels(pred: DataFrame, train: DataFrame, prediction: str, target: str) -> DataFrame:
    """Predicted labels that training never had."""
    return pred.select(F.col(prediction).alias("label")).distinct().join(train.select(F.col(target).alias("label")), "label", "left_anti")


def ordered_shards(df: DataFrame, keys: list[Column | str], shards: int | None = None) -> DataFrame:
    """The rows dealt by ranges of the keys and sorted in each partition: the partitions, one after the other, are the table in order. Rows of equal keys are
    parted by a hash and then at random, so that no key fills a partition alone."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    hashed = [c for c, kind in df.dtypes if not kind.startswith("map")]
    rows = df.withColumns({"_hash": F.xxhash64(*(F.col(f"`{c}`") for c in hashed)) if hashed else F.lit(0), "_any": F.rand(7)})
    by = [*columns, F.col("_hash"), F.col("_any")]
    dealt = rows.repartitionByRange(shards, *by) if shards else rows.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by).drop("_hash", "_any")


def numbered(df: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Adds row_id from 0 in key order (rows of equal keys in any). No task orders more than its range: the sorted ranges are written once with places of their own, and a
    range's first number is the length of those before it, which is one number a range."""
    path = own_path(df.sparkSession, "ranges")
    place = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's place in it
    ordered_shards(df, keys).withColumn("_place", place).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumns({"_range": F.shiftright("_place", 33), "_at": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    offsets, before = [], 0
    for r in rows.groupBy("_range").count().orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_range long, _before long"))
    return rows.join(starts, "_range").select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_before") + F.col("_at")).alias("row_id"))


def check_output(sub: DataFrame, template: DataFrame, target: str) -> list[str]:
    """What is wrong with a submission: shape, columns, nulls, negatives."""
    out = []
    if set(sub.columns) != set(template.columns):
        out.append(f"columns differ: {sorted(set(sub.columns) ^ set(template.columns))}")
    if (a := sub.count()) != (b := template.count()):
        out.append(f"{a} rows for {b}")
    r = stats(sub, target).first()
    return out + [f"{r[k]} {k}" for k in ("n_null", "n_negative") if r[k]]
