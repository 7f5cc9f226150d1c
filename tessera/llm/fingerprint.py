"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below ``fraction`` of the 64-bit range, so the sketch of
a union is the union of sketches and containment can be estimated between texts of very
unequal length. A text of fewer than ``FLOOR`` shingles keeps all its hashes, and so do merged sketches until they have as many; two
sketches of which one is whole are compared below the threshold. Should no hash of a longer text lie below it, its least one stays, so only
texts without words have an empty sketch. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a shingle is five words, or all
words of a shorter text.

Defined results: a null text is the empty text; it and a text without words have the fingerprint
``0:``, their likeness is 1 among themselves and 0 to others, and nothing of them is contained in another. Equal texts have equal
fingerprints, and texts whose shingle sets differ have the likeness 1 only if their sketches are equal. Rows that share a doc_id stay
separate rows, ordered by their text. A null doc_id sorts first. An empty table gives an empty
result. Other input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import shingle_sets

FRACTION = 1 / 4
FLOOR = 64
Sketch = tuple[int, np.ndarray]  # number of distinct shingles, sorted hashes that are kept


def threshold(fraction: float) -> np.uint64:
    return np.uint64(min(int(fraction * 2.0**64), 2**64 - 1))


def sketch(n: int, hashes: np.ndarray, fraction: float = FRACTION) -> Sketch:
    """What is kept of a set of n shingles, given all its sorted hashes or all below the threshold."""
    if n < FLOOR:
        return n, hashes
    return n, hashes[: max(1, int(np.searchsorted(hashes, threshold(fraction))))]


def sketches(texts, fraction: float = FRACTION) -> list[Sketch]:
    """The sketch of each text."""
    return [sketch(len(s), s, fraction) for s in shingle_sets(texts)]


def whole(s: Sketch) -> bool:
    return len(s[1]) == s[0]


def merge(a: Sketch, b: Sketch, fraction: float = FRACTION) -> Sketch:
    """The sketch of two texts taken together; beyond FLOOR shingles their number is estimated."""
    both = np.union1d(a[1], b[1])
    if whole(a) and whole(b):
        return sketch(len(both), both, fraction)
    below = both[: np.searchsorted(both, threshold(fraction))]
    return max(FLOOR, a[0], b[0], round(len(below) / fraction)), below if len(below) else both[:1]


def _comparable(a: Sketch, b: Sketch, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    if whole(a) == whole(b):
        return a[1], b[1]
    limit = threshold(fraction)
    return tuple(s[1][: np.searchsorted(s[1], limit)] if whole(s) else s[1] for s in (a, b))


def likeness(a: Sketch, b: Sketch, fraction: float = FRACTION) -> float:
    """Estimated Jaccard similarity of two shingle sets."""
    if not a[0] and not b[0]:
        return 1.0
    x, y = _comparable(a, b, fraction)
    common = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - common
    return common / union if union else 0.0


def containment(a: Sketch, b: Sketch, fraction: float = FRACTION) -> float:
    """Estimated share of a's shingles that b has too; 0 where a has none that can be compared."""
    x, y = _comparable(a, b, fraction)
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else 0.0


def encode(sketch: Sketch) -> str:
    """The number of shingles, a colon, and the hashes as little-endian 64-bit words in base 64."""
    return f"{sketch[0]}:{base64.b64encode(sketch[1].astype('<u8').tobytes()).decode()}"


def decode(fingerprint: str) -> Sketch:
    """The sketch that encode() wrote."""
    n, _, words = fingerprint.partition(":")
    return int(n), np.frombuffer(base64.b64decode(words), "<u8")


def fingerprints(docs: DataFrame, text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Adds ``fingerprint`` to a table, one row a row."""
    schema = docs.schema.add("fingerprint", "string") if "fingerprint" not in docs.columns else docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [encode(s) for s in sketches(b.column(text), fraction)]
            kept = [c for c in b.schema.names if c != "fingerprint"]
            made = dict(zip(kept, (b.column(c) for c in kept), strict=True)) | {"fingerprint": pa.array(codes, pa.string())}
            yield pa.RecordBatch.from_arrays([made[f.name] for f in schema], names=schema.names)

    return docs.mapInArrow(run, schema)


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key: a binary search inside Spark; null keys get 0."""
    steps = max(1, len(bounds)).bit_length()
    at = F.array(*[F.lit(int(b)) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    tries = F.array(*[F.lit(1 << i) for i in range(steps - 1, -1, -1)])
    found = F.aggregate(tries, F.lit(0), lambda pos, step: F.when((pos + step <= len(bounds)) & (F.get(at, pos + step - 1) <= key), pos + step).otherwise(pos))
    return F.when(key.isNull(), F.lit(0)).otherwise(found)


def with_next(docs: DataFrame, key: str, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Deals rows out by ranges of ``key``, in order, with the first row of the following range as a halo.

    Returns key, columns, ``_bucket`` and ``_halo``; the rows of a bucket lie in one partition in order and
    its halo row (the first of the next bucket that has rows; after the last, the first of all) comes
    last. Only the bounds (a few for each shuffle partition) come to the driver. Text moves once.
    """
    spark = docs.sparkSession
    docs = docs.select(key, *columns)
    n = buckets or min(65536, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 20 * n).alias("q")).first()["q"] or []
    bounds = sorted(set(cuts))
    bucket = bucket_of(F.col(key), bounds)
    firsts = docs.groupBy(bucket.alias("b")).agg(F.min(key).alias("k"), F.max(F.col(key).isNull()).alias("null")).collect()
    order = sorted((r["b"], None if r["null"] else r["k"]) for r in firsts)
    keys = [(k, order[i - 1][0]) for i, (_, k) in enumerate(order) if k is not None]
    at = bucket_of(F.col(key), [k for k, _ in keys]) - 1
    starts, targets = (F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<bigint>") for xs in ([k for k, _ in keys], [t for _, t in keys]))
    halo = F.when(F.get(starts, at) == F.col(key), F.get(targets, at).cast("int"))
    if order and order[0][1] is None:
        halo = F.when(F.col(key).isNull(), F.lit(order[-1][0])).otherwise(halo)
    place = F.array(F.struct(bucket.alias("b"), F.lit(0).alias("h")), F.struct(halo.alias("b"), F.lit(1).alias("h")))
    dealt = docs.select(key, *columns, F.explode(F.filter(place, lambda p: p["b"].isNotNull())).alias("_p"))
    dealt = dealt.select(key, *columns, F.col("_p.b").alias("_bucket"), F.col("_p.h").alias("_halo"))
    return dealt.repartition(n, "_bucket").sortWithinPartitions("_bucket", "_halo", key, *columns)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def edited_fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text and of its edited text: its last half gives way to the next document's start."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        own = sketches(pa.array([r[1] for r in rows], pa.string()), fraction)
        made, after = [], []
        for _, t, follow in rows:
            half = len(t) // 2
            made.append(t[: len(t) - half] + follow[:half])
            after.append(follow)
        edited = sketches(pa.array(made, pa.string()), fraction)
        following = own[1:] + sketches(pa.array(after[-1:], pa.string()), fraction)
        for i in range(len(rows) - 1):  # across a bucket's end the follower isn't the next row
            if rows[i][2] != rows[i + 1][1]:
                following[i] = sketches(pa.array([rows[i][2]], pa.string()), fraction)[0]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(m.encode()).hexdigest() for m in made], pa.string()),
                pa.array([encode(s) for s in own], pa.string()),
                pa.array([encode(s) for s in edited], pa.string()),
                *(pa.array([f(a, b, fraction) for a, b in zip(own, others, strict=True)], pa.float64()) for f in (likeness, containment) for others in (edited, following)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, chars = None, [], 0  # held: (bucket, doc_id, text) that waits for its follower
        for b in batches:
            ids, texts, where, halo = (b.column(i) for i in range(4))
            for i in range(b.num_rows):
                text, at = texts[i].as_py() or "", where[i].as_py()
                if held is not None and held[0] == at:
                    rows.append((held[1], held[2], text))
                    chars += len(held[2]) + len(text)
                    if len(rows) >= 2000 or chars > 8_000_000:
                        yield emit(rows)
                        rows, chars = [], 0
                held = None if halo[i].as_py() else (at, ids[i].as_py(), text)
        if rows:
            yield emit(rows)

    return with_next(docs, "doc_id", ["text"]).mapInArrow(run, RESULT)
