"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text (``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, without ASCII punctuation at their ends) and their
first four, five and six bytes, hashed to 2^20 buckets; a text has each term once. Kept are those buckets
whose share differs between the classes (at most ``TERMS``) and, of the ``PAIRED`` that divide the texts most evenly, those whose odds are changed by
another's presence (at most ``PARTNERS``), so a word that tells nothing by itself is kept for what it tells in company. Over these the machine
has a bias, a weight a term and ``RANK`` factors a term, so that pairs of terms count for more or less than their sum.

The fit takes a bounded sample (see ``labelled.sample``: at most 12,000 labelled documents, with their whole texts); their terms are found where
they lie, and one task of an executor fits the machine. Defined results: a null or empty text has no terms and the bias's score. With labels of one class only or none, the score is the smoothed share of label 1. Rows
with the same doc_id are scored one by one. An empty table gives an empty result. Other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import fold, in_one_task, sample
from tessera.llm.store import trim
from tessera.llm.text import buffers, slices, word_spans

BITS = 20
PREFIXES = (4, 5, 6)
TERMS = 4096
RANK = 4
THRESHOLD = 0.3
CLEAR = 3.5  # standard errors by which a term's log odds must differ from those of all texts
PAIRED, PARTNERS = 1024, 256
CHANGED = 6.0  # standard errors by which one term must change another's log odds: there are half a million pairs


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def terms(texts, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, term) pairs, sorted; keep maps buckets to terms, -1 for none."""
    data, offsets = buffers(texts)
    out = [np.zeros(0, np.int64)]
    for starts, _, hashes, heads in word_spans(data, offsets, tails=True, prefixes=PREFIXES):
        doc = np.searchsorted(offsets, starts, "right") - 1
        for d, h in ((doc, hashes), *((doc[at], h) for at, h in heads)):
            t = (h >> np.uint64(64 - BITS)).astype(np.int64)
            if keep is not None:
                t = keep[t]
                d, t = d[t >= 0], t[t >= 0]
            out.append(np.unique(d << BITS | t))
    both = np.unique(np.concatenate(out))
    return both >> BITS, both & ((1 << BITS) - 1)


def margins(rows: np.ndarray, cols: np.ndarray, n: int, m: Model) -> np.ndarray:
    """The machine's value for each of n texts."""
    out = m.bias + np.bincount(rows, m.weights[cols], n)
    for f in range(m.factors.shape[1]):
        v = m.factors[cols, f]
        out += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
    return out


def interacting(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Of the terms ``among``, those of pairs (a, b) where b's log odds ratio with a present differs from that with a absent by over
    CHANGED standard errors; the clearest pairs' first, at most PARTNERS."""
    k = len(among)
    index = np.full(1 << BITS, -1, np.int32)
    index[among] = np.arange(k, dtype=np.int32)
    at = index[cols]
    own_rows, at = rows[at >= 0], at[at >= 0]
    delta, error = np.zeros((k, k)), np.zeros((k, k))
    for c, sign in ((1, 1), (0, -1)):
        n = int((y == c).sum())
        place = np.cumsum(y == c) - 1  # a bit for each text of the class
        mine = y[own_rows] == c
        bits = np.zeros((k, -(-n // 64) * 64), bool)
        bits[at[mine], place[own_rows[mine]]] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        del bits
        both = np.stack([np.bitwise_count(words & w).sum(1, dtype=np.int64) for w in words]).astype(float)
        each = np.diag(both)
        for cell, way in ((both, 1), (each[:, None] - both, -1), (each[None, :] - both, -1), (n - each[:, None] - each[None, :] + both, 1)):
            delta += sign * way * np.log(cell + 0.5)
            error += 1 / (cell + 0.5)
    z = np.triu(np.abs(delta) / np.sqrt(error), 1)
    a, b = np.unravel_index(np.argsort(-z, axis=None, kind="stable")[: PARTNERS * 8], z.shape)
    clear = z[a, b] >= CHANGED
    found = dict.fromkeys(np.stack([a[clear], b[clear]], 1).reshape(-1).tolist())
    return among[np.array(sorted(list(found)[:PARTNERS]), np.int64)]


def learn(table: pa.Table, steps: int = 150, seed: int = 7) -> Model:
    """Adam on the log loss of all (doc_id, y, terms) with L2 penalties; the same table gives the same model."""
    y = table["y"].to_numpy().astype(float)
    n, up = len(y), y.sum()
    prior = (up + 1) / (n + 2)
    bias = float(np.log(prior / (1 - prior)))
    if not up or up == n:
        return Model(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, RANK)))
    data, offsets = buffers(table["terms"])
    cols, rows = data.view("<i4"), np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets) // 4)
    size = 1 << BITS
    seen, bad = np.bincount(cols, minlength=size), np.bincount(cols[(y == 1)[rows]], minlength=size)
    often = np.flatnonzero(seen >= 3)
    if not len(often):
        return Model(often, bias, np.zeros(0), np.zeros((0, RANK)))
    counts, bad = seen[often], bad[often]
    good = counts - bad
    odds = np.log((bad + 0.5) / (up - bad + 0.5)) - np.log((good + 0.5) / (n - up - good + 0.5))
    error = np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5) + 1 / (up - bad + 0.5) + 1 / (n - up - good + 0.5))
    z = np.abs(odds) / error
    best = np.argsort(-z, kind="stable")[:TERMS]
    best = best[z[best] >= CLEAR]
    even = np.argsort(-np.minimum(counts, n - counts), kind="stable")[:PAIRED]
    paired = np.searchsorted(often, interacting(rows, cols, y, often[even]))
    best = np.union1d(best, paired)
    kept, odds = often[best], odds[best]
    if not len(kept):
        return Model(kept, bias, np.zeros(0), np.zeros((0, RANK)))
    index = np.full(size, -1, np.int32)
    index[kept] = np.arange(len(kept), dtype=np.int32)
    at = index[cols]
    rows, cols = rows[at >= 0].astype(np.int64), at[at >= 0].astype(np.int64)
    del at, data
    k = len(kept)
    w = np.concatenate([[bias], np.clip(odds, -1, 1) * 0.5])
    v = np.random.default_rng(seed).normal(0, 0.01, (k, RANK))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    for step in range(1, steps + 1):
        sums = np.stack([np.bincount(rows, v[cols, f], n) for f in range(RANK)], 1)
        pairs = 0.5 * (sums**2 - np.stack([np.bincount(rows, v[cols, f] ** 2, n) for f in range(RANK)], 1)).sum(1)
        p = 1 / (1 + np.exp(-np.clip(w[0] + np.bincount(rows, w[1:][cols], n) + pairs, -30, 30)))
        e = (p - y) / n
        own = np.bincount(cols, e[rows], k)
        gw = np.concatenate([[e.sum()], own + 1e-4 * w[1:]])
        gv = np.stack([np.bincount(cols, (e[:, None] * sums)[rows, f], k) for f in range(RANK)], 1) - v * own[:, None] + 1e-3 * v
        for x, g, a, b in ((w, gw, state[0], state[1]), (v, gv, state[2], state[3])):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Model(kept, float(w[0]), w[1:], v)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    """The machine of a sample of labelled documents; it alone comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            r, c = terms(b.column(2))
            ends = np.searchsorted(r, np.arange(b.num_rows + 1))
            found = c.astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([found[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())], names=["doc_id", "y", "terms"])

    rows = sample(docs, labels, "toxic", folds, held_out).mapInArrow(run, "doc_id long, y int, terms binary")
    return in_one_task(rows.repartition(1), learn)


def _scores(texts, m: Model, keep: np.ndarray) -> np.ndarray:
    rows, cols = terms(texts, keep) if len(m.buckets) else (np.zeros(0, np.int64),) * 2
    return 1 / (1 + np.exp(-np.clip(margins(rows, cols, len(texts), m), -30, 30)))


def _keep(m: Model) -> np.ndarray:
    keep = np.full(1 << BITS, -1)
    keep[m.buckets] = np.arange(len(m.buckets))
    return keep


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _keep(model)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b.column(1), model, keep))], names=["doc_id", "score"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, whose score lies below the threshold."""
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _keep(model)
        for b in slices(batches):
            yield b.filter(pa.array(_scores(b.column(at), model, keep) < THRESHOLD))
        trim()

    return docs.mapInArrow(run, schema)
