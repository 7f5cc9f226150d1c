"""Quality by compression: zstandard dictionaries of good and of bad text, and their size difference.

A text is cut in blocks of ``BLOCK`` bytes, so that the dictionaries and not the text's own past explain
it, and every block is compressed with either dictionary. The difference of the sums, bad less good, over the
text's bytes is the measure; a rising curve turns it into a score. Every labelled document is part of both: the curve is fitted to measures by
dictionaries that have not seen the document, those of the other ``PARTS`` - 1 parts of the labels.

The fit takes a bounded sample (see ``labelled.sample``: at most 12,000 labelled documents, with their whole texts) and runs in one task of an executor.
Defined results: a null or empty text has the measure 0. With labels of one class only, the score is that class's smoothed share; with none, 0.5. Rows
with the same doc_id are scored one by one, equal texts alike. A score equal to the threshold is kept. A text of any length is measured whole, block by block. An empty
table gives an empty result. Other input columns are not read; ``accepted`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import fold, in_one_task, isotonic, sample
from tessera.llm.text import buffers

BLOCK = 1024
DICTIONARY = 65_536
LEVEL = 16
THRESHOLD = 0.3
PARTS = 5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    knots: tuple[float, ...]
    shares: tuple[float, ...]

    def score(self, measure: np.ndarray) -> np.ndarray:
        return np.interp(measure, self.knots, self.shares)


def dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; of too little text to train on, that text itself."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


def compressor(words: bytes):
    import zstandard

    if not words:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    held = zstandard.ZstdCompressionDict(words)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


def measures(texts, good, bad) -> np.ndarray:
    """(bytes with the bad dictionary - bytes with the good one) / bytes, of each text of an Arrow column."""
    data, at = buffers(texts)
    view, out = memoryview(np.ascontiguousarray(data)), np.zeros(len(at) - 1)
    for i in range(len(out)):
        lo, hi = int(at[i]), int(at[i + 1])
        total = 0
        for a in range(lo, hi, BLOCK):
            piece = view[a : min(hi, a + BLOCK)]
            total += len(bad.compress(piece)) - len(good.compress(piece))
        out[i] = total / (hi - lo) if hi > lo else 0.0
    return out


def dictionaries(y: np.ndarray, texts: pa.Array, chosen: np.ndarray) -> tuple[bytes, bytes]:
    """(good, bad) of the chosen rows."""
    by_class = [[t.as_py().encode() for t in texts.filter(pa.array(chosen & (y == k))) if t.as_py()] for k in (1, 0)]
    good, bad = (dictionary(t) if t else b"" for t in by_class)
    return good, bad


def parts(y: np.ndarray) -> np.ndarray:
    """The part of each row: those of either class are dealt out in turn."""
    out = np.zeros(len(y), np.int64)
    for k in (0, 1):
        out[y == k] = np.arange(np.sum(y == k)) % PARTS
    return out


def part_measures(y: np.ndarray, texts: pa.Array, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(y, measure) of one part's rows, by dictionaries of the other parts."""
    part = parts(y)
    own = np.flatnonzero(part == p)
    if not len(own):
        return y[own], np.zeros(0)
    good, bad = dictionaries(y, texts, part != p)
    return y[own], measures(texts.take(pa.array(own)), compressor(good), compressor(bad))


def learn(rows: pa.Table) -> Model:
    """A model of (doc_id, y, text), by doc_id. Each of PARTS parts is measured with dictionaries of the others; the curve is fitted to all these
    measures, and the model's dictionaries are made of all rows."""
    y, texts = rows["y"].to_numpy(), rows["text"].combine_chunks()
    measured = [part_measures(y, texts, p) for p in range(PARTS)]
    curve = isotonic(np.concatenate([x for _, x in measured]), np.concatenate([k for k, _ in measured]))
    return Model(*dictionaries(y, texts, np.ones(len(y), bool)), *curve)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Model:
    """The model of a sample of labelled documents; it alone comes to the driver."""
    return in_one_task(sample(docs, labels, "quality", folds, held_out), learn)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, measure) of every row of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = compressor(model.good), compressor(model.bad)
        for b in batches:
            x = measures(b.column(1), good, bad)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x)), pa.array(x)], names=["doc_id", "score", "measure"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, measure double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that the model scores at the threshold or above."""
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = compressor(model.good), compressor(model.bad)
        for b in batches:
            yield b.filter(pa.array(model.score(measures(b.column(at), good, bad)) >= THRESHOLD))

    return docs.mapInArrow(run, schema)
