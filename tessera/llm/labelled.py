"""A bounded sample of labelled documents, fits in one task, and the monotone calibration of one measure."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import trim

ROWS = 12_000


def fold(folds: int):
    """crc32 of doc_id as text, modulo ``folds``; 0 for a null doc_id."""
    return F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = ROWS) -> DataFrame:
    """(doc_id, y, text) of at most ``rows`` labelled documents outside the held-out fold: the first by hash of doc_id, with their whole texts.

    Labels other than 0 and 1, and nulls, are ignored; of a doc_id with several labels the largest holds, and of one with several texts
    the least. So the sample doesn't depend on the order or place of rows. The ids are broadcast: rows * 16 bytes at most.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(fold(folds) != held_out)
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    ids = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def in_one_task(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of a bounded table, rows by doc_id, on an executor: only its result comes to the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.cast(schema) for b in batches]
        table = pa.Table.from_batches(held, schema).sort_by("doc_id")
        del held
        made = pickle.dumps(fit(table))
        del table
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit(schema.empty_table())


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Knots (x, P(y = 1)) of a rising calibration curve, to be joined by straight lines.

    Rows of equal x are one pool from the start, and neighbours whose shares fall are pooled until none do; each pool stands at its mean x with its share, drawn by
    one pseudo-row towards the share of all. Without rows it is 0.5 everywhere.
    """
    if not len(x):
        return (0.0,), (0.5,)
    levels, at, n = np.unique(x, return_inverse=True, return_counts=True)
    ones = np.bincount(at, y)
    prior = (float(y.sum()) + 1) / (len(y) + 2)
    pools: list[list[float]] = []  # sum of x, sum of y, rows
    for a, b, k in zip(levels.tolist(), ones.tolist(), n.tolist(), strict=True):
        pools.append([a * k, b, float(k)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    knots, shares = [p[0] / p[2] for p in pools], [(p[1] + prior) / (p[2] + 1) for p in pools]
    return tuple(knots), tuple(np.maximum.accumulate(shares))
