"""Mixture-controlled packing: deficit round-robin over source queues that fills every window to its token proportions.

A source's queue is a stream of tokens, its documents one after the other. In every window each source's deficit counter gains its quantum
(its target share of the window's tokens) and the source sends as many tokens as the counter holds; what rounding leaves over goes to the
largest counters, so a window is full and each counter, carried on to the next window, stays below a token or so. Quanta are
multiples of 1 / ``BLOCK``, so after ``BLOCK`` windows all counters stand at 0 again, and the sends of one block are those of all: a
table of blocks (``Plan``) tells for any token of a queue its window and offset, and running sums tell for any document its place in its
queue. So there is no sequential pass over documents, whatever the windows and partitions.

A source that runs dry gives what it has to one more window, and those that are left share the windows after it by their targets. At most
``QUEUES`` sources (those with targets, then those with most tokens) have a queue of their own; the others share one, in which they
follow each other by hash. Only the last sequence has padding.

Defined results: a null text is empty; every document ends with one ``end`` id, so an empty one has
one token. A null source is a source of its own. Rows with the same doc_id are separate documents. A queue's order is by hash of
doc_id. An empty table gives no pieces. Other input columns are ignored. Targets that are not above 0 are an error; so are more targets than
``QUEUES``. A source without a target gets its share of all tokens; a target for a source that isn't there is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import materialise, trim
from tessera.llm.tokens import TOKENIZER, as_arrow, as_ids, encoder, token_path, width

LENGTH = 2048
END_ID = 1
QUEUES = 128
BLOCK = 256
SLICE_ROWS = 4000  # documents in a slice, about, were all in one queue


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER, end: int | None = END_ID) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian, two bytes an id, four of a tokenizer with more ids, ending in ``end``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoder(token_path(tokenizer)), width(tokenizer, end)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids, offsets = enc.encode(b.column(2))
                if end is not None:
                    ids = np.insert(ids, offsets[1:], end)
                    offsets = offsets + np.arange(len(offsets))
                sizes = pa.array(np.diff(offsets), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sizes, as_arrow(ids, offsets, size).cast(pa.binary())], names=["doc_id", "source", "n_tokens", "ids"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(run, "doc_id long, source string, n_tokens long, ids binary")


@dataclass(frozen=True)
class Phase:
    """Windows from ``first`` on with one set of queues. sent[w, i]: tokens of queues[i] in the first w windows of a block (row 0 is 0)."""

    first: int
    windows: int
    queues: np.ndarray
    base: np.ndarray  # tokens that each of the queues has sent before
    sent: np.ndarray
    offset: np.ndarray  # where each of the queues begins in a window


def quanta(share: np.ndarray, length: int, block: int = BLOCK) -> np.ndarray:
    """Whole tokens of each queue in a block of windows: shares of length * block, the largest remainders rounded up."""
    exact = share / share.sum() * length * block
    out = np.floor(exact).astype(np.int64)
    out[np.argsort(out - exact, kind="stable")[: length * block - int(out.sum())]] += 1
    return out


def block_of(quantum: np.ndarray, length: int, windows: int = BLOCK, block: int = BLOCK) -> np.ndarray:
    """Tokens that each queue sends in each of the first windows of a block; quantum / block comes to a counter in every window."""
    out = np.zeros((windows, len(quantum)), np.int64)
    counter = np.zeros(len(quantum), np.int64)  # in parts of 1 / block
    for w in range(windows):
        counter += quantum
        if w == block - 1:
            send = counter // block
        else:
            send = np.maximum(counter // block, 0)
            over = length - int(send.sum())
            left = counter - send * block
            if over >= 0:
                send[np.argsort(-left, kind="stable")[:over]] += 1
            else:
                may = np.flatnonzero(send)
                send[may[np.argsort(left[may], kind="stable")[:-over]]] -= 1
        counter -= send * block
        out[w] = send
    return out


def plan(tokens: list[int], share: list[float], length: int = LENGTH) -> list[Phase]:
    """The phases of all queues: each lasts as long as all of its queues can fill every window, and one window more takes what is left of those that can't."""
    rest, share = np.array(tokens, np.int64), np.array(share, float)
    done, phases, first = np.zeros(len(rest), np.int64), [], 0

    def add(queues: np.ndarray, sends: np.ndarray, windows: int) -> None:
        nonlocal first
        sent = np.concatenate([np.zeros((1, len(queues)), np.int64), np.cumsum(sends, 0)])
        phases.append(Phase(first, windows, queues, done[queues].copy(), sent, np.cumsum(sends, 1) - sends))
        first += windows
        moved = sent[-1] * (windows // len(sends)) + sent[windows % len(sends)]
        done[queues] += moved
        rest[queues] -= moved

    while (live := np.flatnonzero(rest)).size:
        quantum = quanta(share[live], length)
        fit = int((rest[live] // np.maximum(quantum, 1))[quantum > 0].min())
        if fit:
            add(live, block_of(quantum, length), fit * BLOCK)
            continue
        sends = block_of(quantum, length)
        windows = int((np.cumsum(sends, 0) <= rest[live]).all(1).cumprod().sum())
        if windows:
            add(live, sends[:windows], windows)
        if not (live := np.flatnonzero(rest)).size:
            break
        # the window that a queue can't fill: those that run dry give all, the others the rest by their shares
        send, dry = np.zeros(len(live), np.int64), np.zeros(len(live), bool)
        while True:
            room = length - int(rest[live][dry].sum())
            own = np.zeros(len(live), np.int64)
            if not dry.all():
                own[~dry] = quanta(share[live][~dry], room, 1)
            more = ~dry & (own >= rest[live])
            send = np.where(dry, rest[live], own)
            if not more.any():
                break
            dry |= more
        add(live, send[None, :], 1)
    return phases


def queues_of(counted: DataFrame, targets: dict[str, float] | None, length: int) -> tuple[dict[str | None, int], int, list[Phase]]:
    """(queue of each source that has its own, number of the shared one, phases), from (source, t: tokens)."""
    if targets and min(targets.values()) <= 0:
        raise ValueError("targets must be above 0")
    if targets and len(targets) > QUEUES:
        raise ValueError(f"more than {QUEUES} targets")
    every = counted.agg(F.sum("t").alias("s")).first()["s"] or 0
    named = F.col("source").isin(*targets) if targets else F.lit(False)
    own = counted.orderBy(F.coalesce(named, F.lit(False)).desc(), F.desc("t"), "source").limit(QUEUES).collect()
    own = sorted(own, key=lambda r: (r["source"] is not None, r["source"] or ""))
    tokens = [r["t"] for r in own]
    shares = [float((targets or {}).get(r["source"], r["t"] / max(every, 1))) for r in own]
    if every > sum(tokens):
        tokens.append(every - sum(tokens))
        shares.append(tokens[-1] / every)
    return {r["source"]: i for i, r in enumerate(own)}, len(own), plan(tokens, shares, length)


def placed(held: DataFrame, targets: dict[str, float] | None = None, length: int = LENGTH) -> tuple[DataFrame, list[Phase]]:
    """held (row, doc_id, source, n_tokens and more) with ``queue`` and ``at``, the tokens before each document in its queue; and the phases.

    Running sums go over hash slices of a queue, whose number grows with the table, and over the slices' totals, so no task holds a
    queue. Rows are shuffled once.
    """
    counted = materialise(held.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")), "sources")
    number, shared, phases = queues_of(counted, targets, length)
    slices = max(16, 1 << ((counted.agg(F.sum("n")).first()[0] or 1) // SLICE_ROWS).bit_length())
    known = F.create_map(*[x for s, i in number.items() if s is not None for x in (F.lit(s), F.lit(i))]) if any(s is not None for s in number) else F.lit(None).cast("map<string,int>")
    queue = F.when(F.col("source").isNull(), F.lit(number.get(None, shared))).otherwise(F.coalesce(F.element_at(known, F.col("source")), F.lit(shared)))
    h = F.xxhash64("doc_id")
    keyed = held.withColumns({"queue": queue, "h": h, "slice": F.pmod(h, F.lit(slices))})
    own = ["queue", "slice"]
    behind = Window.partitionBy("queue").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*own).agg(F.sum("n_tokens").alias("all"))
    totals = totals.select(*own, F.coalesce(F.sum("all").over(behind), F.lit(0)).alias("before"))
    so_far = Window.partitionBy(*own).orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.withColumn("upto", F.sum("n_tokens").over(so_far)).join(totals, own)
    return out.withColumn("at", F.col("before") + F.col("upto") - F.col("n_tokens")).drop("h", "slice", "before", "upto"), phases


class Layout:
    """Where the tokens of one queue lie, phase by phase."""

    def __init__(self, phases: list[Phase], queue: int):
        self.parts = []
        for p in phases:
            if len(i := np.flatnonzero(p.queues == queue)):
                sent = p.sent[:, i[0]]
                n = len(sent) - 1
                self.parts.append((p.first, p.windows, int(p.base[i[0]]), sent, p.offset[:, i[0]], n, int(sent[-1])))
        self.starts = np.array([p[2] for p in self.parts])

    def cut(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first token within the queue's range [at, at + n), offset in the window) of each piece."""
        out, end = [], at + n
        for first, windows, base, sent, offset, size, each in self.parts[max(0, int(np.searchsorted(self.starts, at, "right")) - 1) :]:
            if base >= end:
                break
            stop = base + each * (windows // size) + int(sent[windows % size])
            lo, hi = max(at, base) - base, min(end, stop) - base
            if hi <= lo:
                continue
            a = lo // each * size + int(np.searchsorted(sent, lo % each, "right")) - 1
            b = (hi - 1) // each * size + int(np.searchsorted(sent, (hi - 1) % each, "right")) - 1
            w = np.arange(a, b + 1)
            w = w[sent[w % size + 1] > sent[w % size]]
            begin = w // size * each + sent[w % size]
            start = np.maximum(begin, lo)
            out.append((first + w, start + base, offset[w % size] + start - begin))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pack(docs: DataFrame, targets: dict[str, float] | None = None, length: int = LENGTH, tokenizer: str = TOKENIZER, end: int | None = END_ID) -> DataFrame:
    """One row a piece: doc_id, source, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    held = materialise(tokenised(docs, tokenizer, end).withColumn("row", F.monotonically_increasing_id()), "tokens")
    found, phases = placed(held.where("n_tokens > 0"), targets, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts: dict[int, Layout] = {}
        for whole in batches:
            for row in range(0, whole.num_rows, 500):
                b = whole.slice(row, 500)
                n, at, queue = (b.column(i).to_numpy() for i in (2, 4, 5))
                for q in set(queue.tolist()) - layouts.keys():
                    layouts[q] = Layout(phases, q)
                parts = [layouts[q].cut(a, k) for q, a, k in zip(queue.tolist(), at.tolist(), n.tolist(), strict=True)]
                doc = np.repeat(np.arange(b.num_rows), [len(p[0]) for p in parts])
                seq, begin, offset = (np.concatenate([p[i] for p in parts]) for i in range(3))
                begin = begin - at[doc]
                stop = np.append(begin[1:], 0)
                last = np.append(doc[1:] != doc[:-1], True)
                stop[last] = n[doc[last]]
                wide = [as_ids(i.as_buffer(), k).astype("<u4") for i, k in zip(b.column(3), n.tolist(), strict=True)]
                ids = [wide[d][s:e].tobytes() for d, s, e in zip(doc.tolist(), begin.tolist(), stop.tolist(), strict=True)]
                where = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(where), b.column(1).take(where), pa.array(begin), pa.array(stop - begin), pa.array(ids, pa.binary()), pa.array(n[doc]), pa.array(seq), pa.array(offset)],
                    names=["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
        trim()

    return found.select("doc_id", "source", "n_tokens", "ids", "at", "queue").mapInArrow(cut, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pieces(docs: DataFrame) -> DataFrame:
    """The pack of all documents, each piece's ids as their CRC-32."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
