"""Exact Jaccard self-join of documents as sets of word shingles, in a metric space with pivots.

Jaccard distance is a metric, and most documents lie at distance 1 from most others, so pivots are taken where
documents meet. 1. Documents with equal sets become one set. 2. Every set lists its rarest shingles, just as many as
make sure that two linked sets list one in common; rarity comes from exact counts of all shingles of one set in ``SAMPLED``, of
which the ``COMMON`` most frequent are told apart; it sets an order and can't change results. 3. Of the sets that list a shingle the one
with the smallest digest is its pivot, and a pivot's region holds all sets it was chosen for: two linked
sets always share a region. A set counts for a shingle only if another one that lists the shingle may be linked with it as to their sizes and the shingle's places
in their orders (``fitting``), so that the sets that share a shingle by chance, which grow with the square of the input, stay out. Before any text moves, regions of up to ``FEW`` sets are parted by a lower bound of the
distance: the number of bits in which two parity sketches differ, which never exceeds the symmetric
difference of the sets. 4. A region of over ``REGION`` shingles is cut in Spark: up to ``PIVOTS`` further pivots that aren't linked with each other,
every set's distance from each, and Voronoi cells; a set goes to its nearest pivot's cell and, as the boundary, to each cell whose pivot is farther by
no more than twice the link distance and no farther than the cell's radius plus the link distance (triangle inequality). Rows of (cell, document)
are dealt anew and cut again while they are too large (``cells``). Sets linked with a cell's pivot are in one component at once, so a cell of only
such is done. 5. What fits a task is joined there in the same way: pivots, farthest first, cells with windows, and those again until they are
small. Sets that are in one component already are not compared. 6. The links, as stars, give components across regions.

A cell that pivots cannot make smaller is cut into near, boundary and outer blocks by the distance from its pivot, of which those pairs are joined that
can hold a link, so nothing unbounded comes to a task and no link is lost. A text is sent once for each block that its own is paired with, so the texts of a group of near
copies that grows with the input are moved as often as it has blocks: ``REGION`` is what a task can hold, not less. Shingles that are common are dealt out by shingle and set, and get their
pivots from partial aggregates.

Defined results: a null text or one without words has no shingles and is linked with nothing; one of fewer words than
``words`` has one shingle. Rows that share a doc_id are one node with the links of each. A row with a null doc_id is linked with
nothing and has a null component. An empty table gives an empty result. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.joins import lookup
from tessera.llm.store import materialise, trim
from tessera.llm.text import SHINGLE_WORDS, mix, shingle_sets, slices

PERCENT = 75
SAMPLED = 16
COMMON = 1 << 18
OFTEN = 4  # times in the sample from which a shingle may be common
REGION = 1 << 20
SETS = 1 << 13  # sets that a task compares, however short they are
DEPTH = 4
PIVOTS = 8
SMALL = 24
HOT = 1024
FEW = 512
PLACES = 6
NEXT = 16  # neighbours in a token's list that are compared by whole columns
WIDE = 1 << 16  # rows of a token's list that a task holds
FILTER = 1 << 24
_U = np.uint64


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed numbers."""
    pair = np.array([len(s), ~len(s)], np.int64).view(_U) + np.array([mix(s).sum(dtype=_U), mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)], _U)
    return tuple(int(x) for x in mix(pair).view(np.int64))


def parity(s: np.ndarray) -> np.ndarray:
    """A bit for each residue of hashes, set where an odd number of a set's hashes have it; about as many bits as hashes."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def apart(sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> np.ndarray:
    """A part number for each set, such that sets of different parts are surely not linked."""
    root = np.arange(len(sizes))
    length = np.array([len(k) for k in sketches])
    stacks = {b: np.stack([sketches[i] for i in np.flatnonzero(length == b)]) for b in np.unique(length)}
    for b, own in stacks.items():
        at = np.flatnonzero(length == b)
        for c, other in ((b, own), (b // 2, stacks.get(b // 2))):
            if other is None:
                continue
            to = np.flatnonzero(length == c)
            mine = own if c == b else own[:, :c] ^ own[:, c:]
            for i, x in enumerate(at):
                total = sizes[x] + sizes[to]
                near = (100 + percent) * np.bitwise_count(mine[i] ^ other).sum(1, dtype=np.int64) <= (100 - percent) * total
                near &= 100 * np.minimum(sizes[x], sizes[to]) >= percent * np.maximum(sizes[x], sizes[to])
                for r in np.unique(root[to[near]]):
                    a, z = sorted((root[x], r))
                    root[root == z] = a
    return root


def parted(rows: DataFrame, percent: int) -> DataFrame:
    """(region, part, doc_id, n) from (region, doc_id, n, sketch) rows that lie together by region and in order of n, without parts of one set. Sets before and behind a gap
    of sizes are in different parts; of those between two gaps over FEW are one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, whole, base, last = None, [], False, 0, 0
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1 and not whole:
                part = apart(np.array([h[1] for h in held]), [np.frombuffer(h[2], np.uint8) for h in held], percent)
                n = np.bincount(part, minlength=len(held))
                out.extend((key, base + int(p), h[0], h[1]) for p, h in zip(part, held, strict=True) if n[p] > 1)
            elif whole:
                out.extend((key, base, h[0], h[1]) for h in held)
            held.clear()

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["region", "part", "doc_id", "n"])
            out.clear()
            return made

        for b in batches:
            for k, *row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if k != key or 100 * last < percent * row[1]:
                    close()
                    key, whole, base = k, False, base + FEW + 1 if k == key else 0
                held.append(row)
                last = row[1]
                if len(held) > FEW:  # as it is, piece by piece
                    whole = True
                    close()
                if len(out) > 10_000:
                    yield batch()
        close()
        if out:
            yield batch()

    return rows.select("region", "doc_id", "n", "sketch").mapInArrow(run, "region long, part long, doc_id long, n long")


def sets_and_counts(docs: DataFrame, words: int) -> DataFrame:
    """A row a document (doc_id, n, d, e: digests, sketch) and, of one set in SAMPLED by digest, the shingles (token, c) as each task has counted them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "d", "e", "sketch", "token", "c"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def count() -> pa.RecordBatch:
            t, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(t), k) for k in kinds[:5]] + [pa.array(t.view(np.int64)), pa.array(c.astype(np.int64))], names=names)

        for b in slices(batches):
            found = shingle_sets(b.column(1), words)
            pairs = [digest(s) for s in found]
            for s, (d, _) in zip(found, pairs, strict=True):  # copies count once a task, or seldom more
                if d % SAMPLED == 0 and len(s) and d not in seen:
                    held.append(s)
                    seen.add(d)
            if len(seen) > 1_000_000:
                seen.clear()
            columns = [b.column(0), [len(s) for s in found], [p[0] for p in pairs], [p[1] for p in pairs], [parity(s).tobytes() for s in found], [None] * len(found), [None] * len(found)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            if sum(map(len, held)) > 500_000:
                yield count()
        if held:
            yield count()
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, d long, e long, sketch binary, token long, c long")


def common_shingles(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles that stand out, how much by: a level from 1 on); at most COMMON of them come to the driver."""
    often = counted.where("token is not null").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= OFTEN)
    found = often.orderBy(F.desc("c"), "token").limit(COMMON).toArrow()
    tokens, c = found["token"].to_numpy().view(_U), found["c"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], (1 + 2 * np.log2(c[order] / OFTEN)).astype(np.uint8)


def listed(docs: DataFrame, common, words: int, percent: int) -> DataFrame:
    """(token, d, n): the rarest shingles of each set, enough for any linked set to share one, and the set's size, below 0 for a common shingle. A token's last PLACES
    bits are not the shingle's but tell how far behind it is in the set's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, level), seen = common.value, set()
        for b in slices(batches):
            tokens, digests, sizes, lengths = [], [], [], []
            for s in shingle_sets(b.column(1), words):
                d = digest(s)[0]
                if not len(s) or d in seen:  # a set is listed once a task, or seldom more
                    continue
                seen.add(d)
                if len(seen) > 1_000_000:
                    seen.clear()
                own = np.zeros(len(s), np.uint8)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    own = np.where(known[at] == s, level[at], 0)
                order = np.argsort(own, kind="stable")[: len(s) - (percent * len(s) + 99) // 100 + 1]
                tokens.append(s[order] & ~_U((1 << PLACES) - 1) | (np.arange(len(order), dtype=_U) << _U(PLACES)) // _U(len(order)))
                digests.append(d)
                sizes.append(np.where(own[order] > 0, -len(s), len(s)))
                lengths.append(len(order))
            if tokens:
                columns = [np.concatenate(tokens).view(np.int64), np.repeat(np.array(digests, np.int64), lengths), np.concatenate(sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["token", "d", "n"])
        trim()

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "token long, d long, n long")


def largest(token: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """The size of the largest set that may be linked with a set of n shingles, if they share none that is rarer than this one of listed()."""
    length = n - (percent * n + 99) // 100 + 1
    before = ((token & ((1 << PLACES) - 1)) * length + (1 << PLACES) - 1) >> PLACES  # at least so many are rarer
    return (100 + percent) * (n - before) // percent - n


def fitting(token: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which rows of whole lists, a token's rows together, have another one in their list that they may be linked with: neither set is larger than the other's place allows.

    The shingles that two sets share come no earlier in either order than the first of them, so at that one's place the sizes bound the union from below and the
    places the intersection from above; where that excludes a link, the pair is left out.
    """
    fits = np.zeros(len(token), bool)
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([first, [len(token)]]))
    left = np.repeat(first + length, length) - np.arange(len(token))  # rows to the list's end
    at = np.flatnonzero(np.repeat(length <= NEXT, length))
    for step in range(1, NEXT):
        at = at[left[at] > step]
        if not len(at):
            break
        near = at[(n[at] <= most[at + step]) & (n[at + step] <= most[at])]
        fits[near] = fits[near + step] = True
    for lo, m in zip(first[length > NEXT], length[length > NEXT], strict=True):  # by the greatest bound of the sets up to a size, and of all but one
        own = np.argsort(n[lo : lo + m], kind="stable") + lo
        size, bound = n[own], most[own]
        best = np.maximum.accumulate(bound)
        holder = np.maximum.accumulate(np.where(bound == best, np.arange(m), 0))
        second = np.full(m, -1)
        for i in range(1, m):
            second[i] = max(second[i - 1], min(best[i - 1], bound[i]))
        end = np.searchsorted(size, bound, side="right") - 1
        safe = np.maximum(end, 0)
        other = np.where(holder[safe] == np.arange(m), second[safe], best[safe])
        fits[own] = (end >= 0) & (other >= size)
    return fits


def elected(postings: DataFrame, percent: int) -> DataFrame:
    """(pivot, d, token) from (token, d, n) rows of listed() that lie together and in order: rows that fit no other row of the token
    give nothing, and the first d of the others is their pivot; of a list of over WIDE rows all count. The distinct rows of a common token, which lie in several places, come back without a pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)
        wide: tuple[int, int] | None = None  # token and pivot of a list that is let through

        def made(rows: np.ndarray, last: bool) -> pa.RecordBatch | None:
            nonlocal held, wide
            often = rows[2] < 0
            rows = np.stack([rows[0] >> PLACES, rows[1], rows[2], largest(rows[0], rows[2], percent)])
            t_often = np.unique(rows[:2, often], axis=1)
            rows = np.concatenate([held, rows[:, ~often]], axis=1)
            if rows.shape[1]:  # copies of a set from several tasks
                rows = rows[:, np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(0)])]
            pairs = [np.zeros((2, 0), np.int64)]
            if wide is not None:
                n = int(np.searchsorted(rows[0], wide[0], side="right"))
                pairs.append(np.stack([np.full(n, wide[1]), rows[1, :n]]))
                rows = rows[:, n:]
            cut = rows.shape[1] if last or not rows.shape[1] else int(np.searchsorted(rows[0], rows[0, -1]))
            held, rows = rows[:, cut:], rows[:, :cut]
            if held.shape[1] > WIDE:
                wide = (int(held[0, 0]), int(held[1, 0]))
                pairs.append(np.stack([np.full(held.shape[1], wide[1]), held[1]]))
                held = held[:, :0]
            if rows.shape[1]:
                rows = rows[:, fitting(rows[0], rows[2], rows[3])]
                first = np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])[: rows.shape[1]]
                pairs.append(np.stack([rows[1, first][np.cumsum(first) - 1], rows[1]]))
            out = np.unique(np.concatenate(pairs, axis=1), axis=1)
            n, m = out.shape[1], t_often.shape[1]
            if not n + m:
                return None
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([out[0], np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n), pa.array(np.concatenate([out[1], t_often[1]])),
                pa.array(np.concatenate([np.zeros(n, np.int64), t_often[0]]), mask=np.arange(n + m) < n)], names=["pivot", "d", "token"])

        for b in batches:
            if b.num_rows and (out := made(np.stack([b.column(i).to_numpy() for i in range(3)]), False)):
                yield out
        if out := made(np.zeros((3, 0), np.int64), True):
            yield out

    return postings.mapInArrow(run, "pivot long, d long, token long")


class Region:
    """Sets that may be linked, and their components so far."""

    def __init__(self, sets: list[np.ndarray], percent: int, block: np.ndarray | None = None):
        self.percent, self.far = percent, 1 - percent / 100
        self.size = np.array([len(s) for s in sets])
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.tokens = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
        self.mark = np.zeros(int(self.tokens.max()) + 1 if len(self.tokens) else 1, bool)
        self.root = np.arange(len(sets))
        self.block = block

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """How many shingles x shares with each of the others."""
        own = self.tokens[self.at[x] : self.at[x + 1]]
        self.mark[own] = True
        n = self.size[others]
        ends = np.cumsum(n)
        where = np.repeat(self.at[others] - ends + n, n) + np.arange(ends[-1])
        out = np.add.reduceat(self.mark[self.tokens[where]].astype(np.int64), ends - n)
        self.mark[own] = False
        return out

    def link(self, x: int, others: np.ndarray, shared: np.ndarray) -> None:
        union = self.size[x] + self.size[others] - shared
        for r in np.unique(self.root[others[100 * shared >= self.percent * union]]):
            a, b = sorted((self.root[x], r))
            if a != b:
                self.root[self.root == b] = a

    def compare(self, members: np.ndarray, distances: np.ndarray) -> None:
        """Tests the pairs of members that sizes, pivots and components leave open."""
        for i, x in enumerate(members[:-1]):
            rest = members[i + 1 :]
            size = self.size[rest]
            open_ = (self.root[rest] != self.root[x]) & (100 * np.minimum(size, self.size[x]) >= self.percent * np.maximum(size, self.size[x]))
            open_ &= (np.abs(distances[i + 1 :] - distances[i]) <= self.far + 1e-9).all(1)
            if self.block is not None:  # pairs within a block belong to that block's own join
                open_ &= self.block[rest] != self.block[x]
            if open_.any():
                others = rest[open_]
                self.link(x, others, self.shared(x, others))

    def join(self, members: np.ndarray) -> None:
        """Finds the components of the members: pivots, cells with their windows, and those again."""
        if len(members) <= SMALL:
            return self.compare(members, np.zeros((len(members), 0)))
        nearest, columns, pivot = np.full(len(members), 2.0), [], 0
        for _ in range(PIVOTS):
            shared = self.shared(members[pivot], members)
            self.link(members[pivot], members, shared)
            columns.append(1 - shared / (self.size[members[pivot]] + self.size[members] - shared))
            nearest = np.minimum(nearest, columns[-1])
            pivot = int(nearest.argmax())
            if nearest[pivot] <= self.far:
                break
        d = np.stack(columns, 1)
        cell = d.argmin(1)
        for j in range(d.shape[1]):
            core = cell == j
            if not core.any():
                continue
            window = d[:, j] <= d[core, j].max() + self.far + 1e-9
            if window.sum() <= 0.7 * len(members):
                self.join(members[window])
            else:  # the cell's own sets against its window, without a further cut
                self._across(members, np.flatnonzero(core), np.flatnonzero(window), d)

    def _across(self, members: np.ndarray, core: np.ndarray, window: np.ndarray, d: np.ndarray) -> None:
        for i in core:
            x, rest = members[i], members[window]
            size = self.size[rest]
            open_ = (self.root[rest] != self.root[x]) & (100 * np.minimum(size, self.size[x]) >= self.percent * np.maximum(size, self.size[x]))
            open_ &= (np.abs(d[window] - d[i]) <= self.far + 1e-9).all(1)
            if self.block is not None:
                open_ &= self.block[rest] != self.block[x]
            if open_.any():
                others = rest[open_]
                self.link(x, others, self.shared(x, others))


def joined(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) stars of linked documents, from (region, i, j, block, doc_id, text) rows that lie together by (region, i, j)."""

    def solve(ids: list[int], blocks: list[int], texts: list[pa.Array], pair: bool) -> pa.RecordBatch | None:
        sets = [s for t in texts for s in shingle_sets(t, words)]
        r = Region(sets, percent, np.array(blocks) if pair else None)
        r.join(np.arange(len(sets)))
        own = np.array(ids)
        linked = r.root != np.arange(len(own))
        if linked.any():
            return pa.RecordBatch.from_arrays([pa.array(own[r.root[linked]]), pa.array(own[linked])], names=["a", "b"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, blocks, texts = None, [], [], []
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                k = tuple(keys[lo].tolist())
                if k != key:
                    if len(ids) > 1 and (out := solve(ids, blocks, texts, key[1] != key[2])):
                        yield out
                    key, ids, blocks, texts = k, [], [], []
                ids += b.column(4).slice(lo, hi - lo).to_pylist()
                blocks += b.column(3).slice(lo, hi - lo).to_pylist()
                texts.append(pa.array(b.column(5).slice(lo, hi - lo).to_pylist(), pa.string()))
        if len(ids) > 1 and (out := solve(ids, blocks, texts, key[1] != key[2])):
            yield out
        del ids, blocks, texts
        trim()

    return rows.select("region", "i", "j", "block", "doc_id", "text").mapInArrow(run, "a long, b long")


def voronoi(rows: DataFrame, held: DataFrame, words: int, percent: int) -> DataFrame:
    """The cells of regions (region, doc_id, n, weight, act): a row for each cell that a document belongs to or borders on, (region: the cell's own, weight: of
    the region it was cut from, pivot, doc_id, n, core: whether the pivot is its nearest, kind: 0 linked with the pivot, 1 within twice the link distance, 2 beyond).

    A document borders only on cells before its own, so two documents meet in the cell of one of them, once. Only pairs with one that has ``act`` are
    called for, so cells without any are left out. Pivots are the first documents of PIVOTS hash classes, without those linked with one before them. A region's documents meet its pivots by
    region and salt, so they never lie in one task.
    """
    far = 1 - percent / 100
    salts = 16
    chosen = rows.groupBy("region", F.pmod(F.xxhash64("doc_id"), F.lit(PIVOTS)).alias("k")).agg(F.min("doc_id").alias("doc_id"))
    # of texts that share the pivot's doc_id one is the pivot; all are measured
    chosen = chosen.join(held, "doc_id").groupBy("region", "doc_id").agg(F.min("text").alias("text"))
    pivots = chosen.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("pivots"))
    pivots = pivots.select("region", "pivots", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    texts = rows.join(held, "doc_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(pivots, ["region", "salt"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_pivots: dict[int, list[tuple[int, np.ndarray]]] = {}
        for b in slices(batches):
            out: list[tuple] = []
            for region, i, n, weight, act, own, found in zip(*(b.column(c).to_pylist() for c in range(5)), shingle_sets(b.column(5), words), b.column(6), strict=True):
                if region not in held_pivots:
                    if len(held_pivots) > 64:
                        held_pivots.clear()
                    known = held_pivots[region] = []
                    raw = found.as_py()
                    for p, s in zip(raw, shingle_sets(pa.array([x["text"] for x in raw], pa.string()), words), strict=True):
                        if all(100 * (c := len(np.intersect1d(s, o, assume_unique=True))) < percent * (len(s) + len(o) - c) for _, o in known):
                            known.append((p["doc_id"], s))
                known = held_pivots[region]
                both = np.array([len(np.intersect1d(own, s, assume_unique=True)) for _, s in known])
                union = np.array([len(own) + len(s) for _, s in known]) - both
                d = 1 - both / union
                least = d.min()
                core = int(d.argmin())
                for j in np.flatnonzero(d[: core + 1] <= least + 2 * far + 1e-9).tolist():
                    kind = 0 if 100 * both[j] >= percent * union[j] else 1 if d[j] <= 2 * far + 1e-9 else 2
                    out.append((region, known[j][0], i, n, weight, kind, act, j == core, float(d[j])))
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.bool_(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], k) for c, k in enumerate(kinds)], names=["region", "pivot", "doc_id", "n", "weight", "kind", "act", "core", "d"])
        trim()

    measured = texts.select("region", "doc_id", "n", "weight", "act", "text", "pivots").mapInArrow(measure, "region long, pivot long, doc_id long, n long, weight long, kind int, act boolean, core boolean, d double")
    measured = materialise(measured, "measured")
    radius = measured.groupBy("region", "pivot").agg(F.max(F.when(F.col("core"), F.col("d"))).alias("radius"), F.max("act").alias("any"), F.count("*").alias("rows")).where("any").drop("any")
    found = lookup(measured, radius, ["region", "pivot"], "rows", measured.count()).where(F.col("d") <= F.col("radius") + far + 1e-9)
    return found.select(F.xxhash64("region", "pivot").alias("region"), "weight", "pivot", "doc_id", "n", "core", "kind")


def cells(rows: DataFrame, held: DataFrame, words: int, percent: int, region: int) -> tuple[DataFrame, DataFrame]:
    """Regions that are too large for a task, (region, doc_id, n, weight), as (rows for joined() without texts, stars of documents linked with a pivot).

    Cells that are too large are cut again; after DEPTH rounds, or where a cell is not a fifth smaller than what it was cut from, by blocks of classes. Those
    linked with the pivot are in one component, by the triangle inequality only documents within twice the link distance of it can be linked with
    one of those, and documents that border on a cell meet elsewhere: so only those blocks are paired that can hold a link which no other place finds.
    """
    zero = F.lit(0).cast("int")
    out, stars, stuck = [], [], []
    rows = rows.withColumn("act", F.lit(True))
    for depth in range(DEPTH):
        found = materialise(voronoi(rows, held, words, percent), "cells")
        stars.append(found.where("kind = 0 and doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")))
        sizes = found.groupBy("region").agg(F.sum("n").alias("now"), F.count_if(F.col("kind") > 0).alias("open"), F.count("*").alias("rows")).where("open > 0").drop("open")
        found = materialise(lookup(found, sizes, ["region"], "rows", found.count()).where("now is not null"), "open")
        out.append(found.where(F.col("now") <= region).select("region", "doc_id", zero.alias("block"), zero.alias("i"), zero.alias("j")))
        large = found.where(F.col("now") > region)
        smaller = (F.col("now") < F.col("weight") * 0.8) & F.lit(depth < DEPTH - 1)
        stuck.append(large.where(~smaller).select("region", "doc_id", "n", (F.col("kind") + F.when(F.col("core"), 0).otherwise(3)).alias("class")))
        rows = large.where(smaller).groupBy("region", "doc_id").agg(F.max("n").alias("n"), F.max("now").alias("weight"), F.max("core").alias("act"))
        if rows.isEmpty():
            break
    left = reduce(DataFrame.unionByName, stuck)
    # classes 0 to 2 are a cell's own documents by kind, 3 to 5 those that border on it
    meets = [(1, 4), (0, 1, 2, 3, 4, 5), (1, 2, 4, 5), (1,), (0, 1, 2), (1, 2)]
    counts = left.groupBy("region").agg(*(F.ceil(F.coalesce(F.sum(F.when(F.col("class") == k, F.col("n"))), F.lit(0)) / F.lit(region)).cast("int").alias(f"k{k}") for k in range(6)))
    blocks = [F.when(F.col(f"k{k}") > 0, F.sequence(F.lit(k << 20), F.greatest(F.col(f"k{k}"), F.lit(1)) + ((k << 20) - 1))).otherwise(F.array().cast("array<int>")) for k in range(6)]
    pick = lambda of: F.coalesce(*(F.when(F.col("class") == k, of(k)) for k in range(6)))
    left = left.join(counts, "region").withColumn("block", (F.pmod(F.xxhash64("doc_id"), pick(lambda k: F.col(f"k{k}"))) + F.shiftleft("class", 20)).cast("int"))
    left = left.select("region", "doc_id", "block", F.explode(pick(lambda k: F.concat(*(blocks[m] for m in meets[k])))).alias("o"))
    left = left.select("region", "doc_id", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    return reduce(DataFrame.unionByName, [*out, left]).distinct(), reduce(DataFrame.union, stars)


def by_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the doc_ids of ``ids``, rows whose key surely is not): a bitmap of hashes of FILTER bits,
    broadcast as at most FILTER / 64 rows, so that few others are shuffled."""
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER))
    word, bit = F.shiftright(h, 6).alias("_w"), h.bitwiseAND(63).cast("int")
    bitmap = ids.where("doc_id is not null").select(word, bit.alias("b")).groupBy("_w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("_bits"))
    h = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(FILTER))
    marked = docs.withColumn("_w", F.shiftright(h, 6)).join(F.broadcast(bitmap), "_w", "left")
    hit = F.coalesce(F.getbit("_bits", h.bitwiseAND(63).cast("int")) == 1, F.lit(False)) & F.col(key).isNotNull()
    return marked.where(hit).drop("_w", "_bits"), marked.where(~hit).drop("_w", "_bits")


def classes(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, region: int = REGION) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of documents."""
    spark = docs.sparkSession
    counted = materialise(sets_and_counts(docs, words), "sets")
    own = counted.where("token is null").select("doc_id", "n", "d", "e", "sketch")
    common = spark.sparkContext.broadcast(common_shingles(counted))
    groups = own.where("n > 0 and doc_id is not null").groupBy("d", "e").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    groups = materialise(groups, "groups")

    # the rows of a common token, which may be in a third of all sets, are dealt out by token and set
    token, salt = F.shiftright("token", PLACES), F.when(F.col("n") < 0, F.pmod("d", F.lit(64))).otherwise(F.lit(0))
    lists = materialise(elected(listed(docs, common, words, percent).repartition(token, salt).sortWithinPartitions(token, "d"), percent), "lists")
    common.unpersist()
    often = lists.where("token is not null").select("token", "d")
    chosen = F.broadcast(often.groupBy("token").agg(F.min("d").alias("pivot"), F.max("d").alias("last")).where("pivot <> last"))  # at most COMMON rows
    among = often.join(chosen, "token").select("pivot", "d")
    members = lists.where("token is null").select("pivot", "d").union(among.union(among.select("pivot", F.col("pivot").alias("d")))).distinct()

    near = members.join(groups.select("d", "rep", "n", "sketch"), "d").select(F.col("pivot").alias("region"), F.col("rep").alias("doc_id"), "n", "sketch")
    near = materialise(near, "near")
    # fewer than HOT regions hold more than 1 / HOT of the rows each; they, too large to be parted anyway, stay where they are
    counts = near.groupBy("region").agg(F.count("*").alias("rows"))
    hot = F.broadcast(counts.where((F.col("rows") > F.lit(near.count() // HOT)) & (F.col("rows") > FEW)).select("region"))
    few = near.join(hot, "region", "left_anti").repartition("region").sortWithinPartitions("region", "n", "doc_id")
    whole = near.join(hot, "region").select("region", F.lit(0).cast("long").alias("part"), "doc_id", "n")
    parts = materialise(parted(few, percent).unionByName(whole), "parts")
    # a short set counts as one of region / SETS shingles
    parts = parts.withColumn("n", F.greatest("n", F.lit(region // SETS)))
    sizes = parts.groupBy("region", "part").agg(F.sum("n").alias("weight"), F.count("*").alias("sets")).where("sets > 1")
    placed = lookup(parts, sizes, ["region", "part"], "sets", parts.count()).where("weight is not null").withColumn("region", F.xxhash64("region", "part"))
    # the texts that are compared, written once: else every round would read all texts and hold the bitmap anew
    held = materialise(by_ids(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), parts)[0], "held")
    zero = F.lit(0).cast("int")
    fit = placed.where(F.col("weight") <= region).select("region", "doc_id", zero.alias("block"), zero.alias("i"), zero.alias("j"))
    large, stars = placed.where(F.col("weight") > region).select("region", "doc_id", "n", "weight"), None
    if not large.isEmpty():
        cut, stars = cells(large, held, words, percent, region)
        fit = fit.unionByName(cut)
    rows = held.join(fit, "doc_id").repartition("region", "i", "j").sortWithinPartitions("region", "i", "j", "doc_id")
    links = joined(rows, words, percent)
    links = links.unionByName(stars) if stars is not None else links
    found = components(materialise(links, "links"))

    labels = groups.join(found, groups["rep"] == found["id"], "left").select("d", "e", "copies", F.coalesce("component", "rep").alias("component"), F.col("component").isNotNull().alias("linked"))
    labels = materialise(labels.where("copies > 1 or linked").drop("linked"), "labels")
    # fewer than HOT sets can have more than 1 / HOT of all rows each
    least = own.count() // HOT
    hot = F.broadcast(labels.where(F.col("copies") > least).drop("copies"))
    own = own.select("doc_id", "n", "d", "e")
    many = own.join(hot, ["d", "e"])
    few = own.join(hot, ["d", "e"], "left_anti").join(labels.where(F.col("copies") <= least).drop("copies"), ["d", "e"], "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return many.unionByName(few).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def representatives(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, without those that a smaller doc_id's document is linked to, over any number of links.

    Of rows that share a doc_id the first by text stays. Rows with a null doc_id all stay. Only the texts of documents that go, and of few others, are shuffled.
    """
    found = materialise(classes(docs, words, percent), "classes")
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    marked = docs.withColumn("_id", F.col("doc_id").cast("long"))
    some, others = by_ids(marked, gone.union(repeated), "_id")
    some = some.join(gone.withColumnRenamed("doc_id", "_id"), "_id", "left_anti")
    some = some.withColumn("_k", F.row_number().over(Window.partitionBy("_id").orderBy("text"))).where("_k = 1")
    return others.select(*docs.columns).unionByName(some.select(*docs.columns))
