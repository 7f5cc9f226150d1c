"""Embedding whitening from exact integer scatter.

Entries become integers, x = floor(1024 * c) + 100000. Tasks subtract a shift and add up sums and cross-products of limbs, each limb's products
exactly in a matrix product of doubles below 2^53; Spark adds the tasks' parts, which are split into 32-bit digits so that no sum overflows.
The driver puts them together as Python integers, forms n * X'X - S S' exactly, and only then converts it to doubles for eigh. So
the components don't depend on the order, number or place of rows, nor on how far the vectors lie from zero. What comes to the driver is
one row for each pair of dimensions, whatever the number of vectors.

Defined results: a vector that is null or holds a null, NaN or infinite entry is dropped. The number of dimensions is the commonest length of the remaining
vectors, the greatest on ties, and at most DIMENSIONS, beyond which it is an error; a vector of another length, or an empty one, is dropped too. Entries whose x no long holds
take the nearest that one does. A deviation beyond a long is null. Repeated rows and equal or null ids stay separate rows, each counted. A
component whose eigenvalue is 0 to working precision (equal vectors, a single one, dimensions that depend on each other) has a null ``whitened``
and no part in ``identity_error``; without any other component that is 0, and without variance ``explained`` is 0. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import materialise

SCALE = 1024.0
OFFSET = SHIFT = 100_000
COMPONENTS = 8
DIMENSIONS = 4096
BLOCK = 1 << 11
LIMB = 20  # bits: BLOCK products of two limbs stay below 2^51
DIGIT = 32
DIGITS = 6
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(vectors: np.ndarray) -> np.ndarray:
    """x of each entry: floor(1024 * c) + 100000, at the bounds of a long where it lies beyond."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * vectors.astype(np.float64))
    inside = np.abs(scaled) < 2.0**62
    return np.where(inside, np.where(inside, scaled, 0.0).astype(np.int64) + OFFSET, np.where(scaled > 0, *_beyond(scaled)))


def _beyond(scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for large entries, as integers without bounds, cut to those of a long."""
    far = np.abs(scaled) >= 2.0**62
    exact = np.zeros(scaled.shape, np.int64)
    for at in zip(*np.nonzero(far), strict=True):
        v = scaled[at]
        exact[at] = MOST if v == np.inf else LEAST if v == -np.inf else min(MOST, max(LEAST, int(v) + OFFSET))
    return exact, exact


def limbs(d: np.ndarray) -> list[np.ndarray]:
    """Arrays of doubles below 2^LIMB by size whose sum, each times 2^(LIMB * k), is |d|, all with the sign of d."""
    sign, size, out = np.sign(d).astype(np.float64), np.where(d < 0, (~d).astype(np.uint64) + np.uint64(1), d.astype(np.uint64)), []
    while not out or size.any():
        out.append((size & np.uint64((1 << LIMB) - 1)).astype(np.float64) * sign)
        size = size >> np.uint64(LIMB)
    return out


class Scatter:
    """Exact sums and cross-products of shifted vectors, as Python integers: row and column 0 stand for the constant 1."""

    def __init__(self, dimensions: int):
        self.sums = np.zeros((dimensions + 1, dimensions + 1), object)

    def add(self, x: np.ndarray, shift: int = SHIFT) -> None:
        for at in range(0, len(x), BLOCK):
            block = x[at : at + BLOCK]
            low, high = int(block.min()), int(block.max())
            if LEAST <= low - shift and high - shift <= MOST:
                parts = limbs(block - shift)
            else:
                parts = [p for p in self._wide(block, shift)]
            one = np.ones((len(block), 1))
            none = np.zeros((len(block), 1))
            parts = [np.hstack([none if k else one, p]) for k, p in enumerate(parts)]
            for i, p in enumerate(parts):
                for j, q in enumerate(parts):
                    made = (p.T @ q).astype(np.int64)
                    self.sums += made.astype(object) << (LIMB * (i + j))

    @staticmethod
    def _wide(block: np.ndarray, shift: int) -> list[np.ndarray]:
        """limbs() of values that leave a long once the shift is subtracted."""
        values = block.astype(object) - shift
        sign, size, out = np.sign(values).astype(np.float64), np.abs(values), []
        while not out or size.any():
            out.append((size & ((1 << LIMB) - 1)).astype(np.float64) * sign)
            size = size >> LIMB
        return out

    def digits(self) -> tuple[list[int], list[int], list[list[int]]]:
        """(i, j, digits) of the upper triangle: digits of DIGIT bits, lowest first, all with the number's sign."""
        rows, columns = np.triu_indices(len(self.sums))
        out = []
        for v in self.sums[rows, columns]:
            size, sign = abs(v), -1 if v < 0 else 1
            out.append([sign * ((size >> DIGIT * k) & ((1 << DIGIT) - 1)) for k in range(DIGITS)])
        return rows.tolist(), columns.tolist(), out


@dataclass
class Fit:
    """n, sums S of x, the exact integers n * X'X - S S', eigenvalues of V by falling size and its unit eigenvectors as columns."""

    n: int
    sums: list[int]
    scatter: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    total: float

    @property
    def live(self) -> int:
        """How many of the components have an eigenvalue that is not 0 to working precision."""
        least = len(self.sums) * np.finfo(float).eps * self.values[0] if len(self.values) else 0.0
        return int(np.sum(self.values > least))


def decompose(n: int, sums: list[int], products: np.ndarray, components: int) -> Fit:
    """From exact sums and cross-products of shifted vectors; the shift falls out of n * X'X - S S'."""
    shifted = np.array(sums, object)
    scatter = n * products - np.outer(shifted, shifted)
    v = (scatter / (n * n)).astype(np.float64)  # integers divided: each entry is rounded once
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    return Fit(n, [s + n * SHIFT for s in sums], scatter, np.maximum(values[order], 0.0), vectors[:, order], float(sum(int(scatter[i, i]) for i in range(len(sums))) / (n * n)))


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(key, vector) of the rows that remain, and the number of dimensions, 0 if no row remains."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    rows = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", entry))
    length = F.size("vector").alias("length")
    most = rows.groupBy(length).count().orderBy(F.desc("count"), F.desc("length")).first()
    dimensions = most["length"] if most else 0
    if dimensions > DIMENSIONS:
        raise ValueError(f"{dimensions} dimensions are more than {DIMENSIONS}")
    return rows.where(F.size("vector") == dimensions), dimensions


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """A list column without nulls as rows of entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def fit(rows: DataFrame, dimensions: int, components: int = COMPONENTS) -> Fit:
    """The components of all rows of usable()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter = Scatter(dimensions)
        for b in batches:
            if b.num_rows:
                scatter.add(whole(matrix(b.column(0), dimensions)))
        i, j, digits = scatter.digits()
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(d, pa.int64()) for d in zip(*digits, strict=True))], names=["i", "j", *(f"d{k}" for k in range(DIGITS))])

    schema = ", ".join(["i int", "j int", *(f"d{k} long" for k in range(DIGITS))])
    parts = rows.select("vector").mapInArrow(run, schema).groupBy("i", "j").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)))
    full = np.zeros((dimensions + 1, dimensions + 1), object)
    for r in parts.collect():
        full[r.i, r.j] = full[r.j, r.i] = sum(r[f"d{k}"] << (DIGIT * k) for k in range(DIGITS))
    return decompose(int(full[0, 0]), [int(s) for s in full[0, 1:]], full[1:, 1:], components)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """(n * x - S as doubles, each rounded once; the exact sum of its squares by row, None beyond a long)."""
    far = max(abs(n * int(x.max()) - min(sums)), abs(n * int(x.min()) - max(sums)), n * int(np.abs(x).max()) if x.min() > LEAST else 1 << 63)
    if far < 1 << 62 and far * far * x.shape[1] <= MOST:
        d = n * x - np.array(sums, np.int64)
        return d.astype(np.float64), (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    squares = (d * d).sum(axis=1)
    return d.astype(np.float64), [int(s) if s <= MOST else None for s in squares]


def projected(rows: DataFrame, f: Fit) -> DataFrame:
    """vec_id, deviation, w: the whitened values of each vector, one for each live component."""
    dimensions, live = len(f.sums), f.live
    axes = f.vectors[:, :live] / np.sqrt(f.values[:live]) / f.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d, squares = deviations(whole(matrix(b.column(1), dimensions)), f.n, f.sums)
            w = np.zeros((len(d), live))
            for column, axis in zip(d.T, axes, strict=True):  # in one order, so that equal vectors have equal values in any batch
                w += column[:, None] * axis
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * live, pa.int32()), pa.array(w.reshape(-1), pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(squares, pa.int64()), lists], names=["vec_id", "deviation", "w"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, w array<double>")


def identity_error(made: DataFrame, live: int) -> float:
    """The largest absolute entry of the whitened values' covariance less the identity; Spark's own covariance centres before it multiplies."""
    pairs = [(i, j) for i in range(live) for j in range(i, live)]
    if not pairs:
        return 0.0
    found = made.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))


def whitened(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining vector and component."""
    kept, dimensions = usable(rows, key, vector)
    kind = kept.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dimensions:
        return kept.sparkSession.createDataFrame([], schema)
    f = fit(kept, dimensions, components)
    made = materialise(projected(kept, f), "whitened")
    error = identity_error(made, f.live)
    shares = F.array(*(F.lit(float(e / f.total) if f.total else 0.0) for e in f.values))
    each = made.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(f.values)))).alias("component"))
    return each.select(
        "vec_id",
        "component",
        F.lit(f.n).cast("long").alias("n"),
        "deviation",
        F.try_element_at("w", F.col("component")).alias("whitened"),
        F.element_at(shares, F.col("component")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
