"""Cross-tokenizer alignment: which tokens of two tokenizers end together, and how often over the corpus.

Both tokenizers read a space and the text. Byte offsets where tokens of both end cut a text into groups; a link is an occurrence of two
tokens, one of each side, that end at the same offset. A two-pointer merge of the cumulative ends finds both inside mapInArrow; Spark counts the
pairs, joins the counts and each side's maxima back to the slices of documents that hold them, and every slice sums up its documents.

A single space between two characters that are no white space begins a token on either side: the byte-level pattern has a match begin
there, and no piece of the other vocabulary has a space behind another character (checked when it is read). So a text is merged in the parts between such
spaces, and a part that has been met is not encoded again.

A *slice* is a run of a partition's documents with at most SLICE bytes of text, or one document. It sends each distinct pair
once, with its number of links, so a pair has one row a slice however frequent it is, and counts come back once a slice.

Defined results: texts that are null or empty, or whose tokens' bytes differ from a space and the text on either side (U+2581 in the
text, say), have no tokens: zeros and an empty groups_sha256. Strings of special tokens are ordinary text; bytes that are no UTF-8 are read as U+FFFD. A token of
no bytes ends where the one before it does. Of equal counts all are the highest. Repeated rows are counted as often as they occur and stay
separate rows, null doc_ids stay null. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import bounded, strings
from tessera.llm.store import materialise

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
SLICE = 4 << 20
HALF = 1 << 18
SPACE = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A part that str.split() cuts wrongly, and one whose tokens don't spell it.
IRREGULAR, DIFFERENT = "irregular", "different"

SLICE_ROWS = "slice long, pair_no int, a int, b int, links long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_best_a long"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on in their order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level tokenizer's file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        self.tokens = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.tokenizer.get_vocab().items()}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]


class Pieces:
    """Side B: a piece model that puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if odd := [p for p in names if re.search(f"[^{SPACE}]{SPACE}", p)]:
            raise ValueError(f"pieces of {path} go on behind a space: {odd[:3]}")
        self.tokens = {i: bytes.fromhex(p[3:5]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return self.model.encode(texts, num_threads=1)


Group = tuple[list[int], list[int]]


def merge(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> tuple[list[Group], list[tuple[int, int]]]:
    """(groups, links): two pointers run over the ends of both sides' tokens; where they meet, a group ends and its last tokens are linked."""
    groups, links = [], []
    i = j = first_a = first_b = 0
    n_a, n_b = len(a), len(b)
    while i < n_a and j < n_b:
        x, y = a_ends[i], b_ends[j]
        if x < y:
            i += 1
        elif y < x:
            j += 1
        else:
            p, q = i + 1, j + 1
            while p < n_a and a_ends[p] == x:
                p += 1
            while q < n_b and b_ends[q] == x:
                q += 1
            if p - i == q - j == 1:
                links.append((a[i], b[j]))
            else:
                links += [(u, v) for u in a[i:p] for v in b[j:q]]
            groups.append((a[first_a:p], b[first_b:q]))
            i, j, first_a, first_b = p, q, p, q
    return groups, links


def written(groups: Iterable[Group]) -> str:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``."""
    return ";".join([f"{a[0]}|{b[0]}" if len(a) == len(b) == 1 else f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups])


#: Tokens of A and of B, groups, the groups as text, the links' codes as 64-bit integers: bytes take the least memory.
Part = tuple[int, int, int, bytes, bytes]


def code(a: int, b: int) -> int:
    return a << 32 | b


class Aligner:
    """Two tokenizers and the parts of texts that they have met: HALF new ones, and those of before until they are met no more."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.met: dict[str | tuple[str], Part | str] = {}
        self.older: dict[str | tuple[str], Part | str] = {}

    def groups(self, a: list[int], b: list[int], text: str) -> tuple[list[Group], list[tuple[int, int]]] | None:
        """What merge() finds; None where either side's bytes differ from a space and the text."""
        a_bytes, b_bytes = list(map(self.a.tokens.__getitem__, a)), list(map(self.b.tokens.__getitem__, b))
        if not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            return None
        return merge(a, list(accumulate(map(len, a_bytes))), b, list(accumulate(map(len, b_bytes))))

    def part(self, a: list[int], b: list[int], text: str) -> Part | str:
        found = self.groups(a, b, text)
        if found is None:
            return DIFFERENT
        groups, links = found
        return len(a), len(b), len(groups), written(groups).encode(), array("q", [code(u, v) for u, v in links]).tobytes()

    def whole(self, text: str) -> tuple[list[Group], list[tuple[int, int]]]:
        """Groups and links of a text taken as one part."""
        return (self.groups(self.a.encode([text])[0], self.b.encode([text])[0], text) if text else None) or ([], [])

    def meet(self, keys: Iterable[str | tuple[str]]) -> None:
        """Encodes the parts that have not been met, all together. A key is a part, or a tuple of one that may begin or end with white space."""
        new = []
        for k in keys:
            if k in self.met:
                continue
            if k in self.older:
                self.met[k] = self.older[k]
            elif isinstance(k, str) and (not k or k[0].isspace() or k[-1].isspace()):
                self.met[k] = IRREGULAR
            else:
                new.append(k)
        parts = [k if isinstance(k, str) else k[0] for k in new]
        for k, text, a, b in zip(new, parts, self.a.encode(parts), self.b.encode(parts), strict=True):
            self.met[k] = self.part(a, b, text)

    def align(self, texts: list[str]) -> list[list[Part]]:
        """The parts of each text in order; none for a text without tokens."""
        if len(self.met) > HALF:
            self.older, self.met = self.met, {}
        keys: list[list[str | tuple[str]]] = [t.split(" ") if t else [] for t in texts]
        self.meet(set().union(*keys))
        found = [[self.met[k] for k in own] for own in keys]
        odd = [n for n, own in enumerate(found) if IRREGULAR in own]
        for n in odd:
            cut = _CUT.split(texts[n])
            keys[n] = [k if k and not k[0].isspace() and not k[-1].isspace() else (k,) for k in cut]
        self.meet({k for n in odd for k in keys[n]})
        for n in odd:
            found[n] = [self.met[k] for k in keys[n]]
        for n, own in enumerate(found):
            if DIFFERENT in own:  # the parts' bytes may still add up
                whole = self.part(self.a.encode(texts[n : n + 1])[0], self.b.encode(texts[n : n + 1])[0], texts[n])
                found[n] = [] if whole == DIFFERENT else [whole]
        return found


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str = BYTE_LEVEL, b: str = PIECES) -> Aligner:
    """This process's aligner of two public tokenizers; their place is asked for where they are used, since machines differ."""
    import public_tokenizers

    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(ByteLevel(public_tokenizers.path(a)), Pieces(public_tokenizers.path(b)))
    return _aligners[a, b]


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of SLICE_ROWS; columns that are not given are null."""
    kinds = {"slice": pa.int64(), "pair_no": pa.int32(), "a": pa.int32(), "b": pa.int32(), "links": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.list_(pa.int32()), "times": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, kind)) for k, kind in kinds.items()], names=list(kinds))


def one_slice(number: int, doc_ids: pa.Array, texts: list[str], own: Aligner) -> Iterator[pa.RecordBatch]:
    """A slice's documents, each with the numbers of its pairs and their times, and the slice's pairs."""
    found = [tuple(zip(*parts, strict=True)) or ((), (), (), (), ()) for parts in own.align(texts)]
    codes = [b"".join(f[4]) for f in found]
    sizes = np.array([len(c) // 8 for c in codes], np.int64)
    codes = np.frombuffer(b"".join(codes), np.int64)
    pairs, at = np.unique(codes, return_inverse=True)
    each, times = np.unique(np.repeat(np.arange(len(texts)), sizes) * max(1, len(pairs)) + at, return_counts=True)
    offsets = np.searchsorted(each, np.arange(len(texts) + 1) * max(1, len(pairs)))
    total = lambda k: pa.array([sum(f[k]) for f in found], pa.int64())
    yield _rows(
        len(texts),
        slice=pa.array(np.full(len(texts), number)),
        doc_id=doc_ids,
        n_a=total(0),
        n_b=total(1),
        n_groups=total(2),
        n_links=pa.array(sizes),
        groups_sha256=pa.array([hashlib.sha256(b";".join(f[3])).hexdigest() if f[3] else "" for f in found]),
        pairs=_lists(each % max(1, len(pairs)), offsets),
        times=_lists(times, offsets),
    )
    yield _rows(
        len(pairs),
        slice=pa.array(np.full(len(pairs), number)),
        pair_no=pa.array(np.arange(len(pairs), dtype=np.int32)),
        a=pa.array((pairs >> 32).astype(np.int32)),
        b=pa.array((pairs & 0xFFFFFFFF).astype(np.int32)),
        links=pa.array(np.bincount(at, minlength=len(pairs)).astype(np.int64)),
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sliced(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES, size: int = SLICE) -> DataFrame:
    """SLICE_ROWS: a row for each document and one for each slice and distinct pair, written once, since a slice's number hangs on its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, number = aligner(a, b), TaskContext.get().partitionId() << 32
        for batch in bounded(batches, 1, size):
            yield from one_slice(number, batch.column(0), strings(batch.column(1)), own)
            number += 1

    return materialise(_texts(docs).mapInArrow(run, SLICE_ROWS), "alignment")


def pair_counts(slices: DataFrame) -> DataFrame:
    """a, b, count, best_a, best_b: how many links of the corpus hold two ids linked, and the highest count of either id."""
    counts = slices.where("pair_no is not null").groupBy("a", "b").agg(F.sum("links").alias("count"))
    sides = {s: counts.groupBy(s).agg(F.max("count").alias(f"best_{s}")) for s in "ab"}
    return counts.join(sides["a"], "a").join(sides["b"], "b").select("a", "b", "count", "best_a", "best_b")


def tally(docs: pa.Table, facts: pa.Table) -> pa.Table:
    """Sums the counts of a slice's pairs by its documents."""
    n = facts.num_rows
    count, is_a, is_b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = facts["pair_no"].to_numpy()
    for values, name in ((count, "count"), (is_a, "is_best_a"), (is_b, "is_best_b")):
        values[at] = facts[name].to_numpy()
    lists = docs["pairs"].combine_chunks()
    pairs = lists.flatten().to_numpy()
    times = docs["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(docs.num_rows), np.asarray(lists.value_lengths()))

    def by_document(values: np.ndarray) -> pa.Array:
        sums = np.concatenate([[0], np.cumsum(values[pairs] * times)])
        ends = np.searchsorted(row, np.arange(docs.num_rows + 1))
        return pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())

    made = {"n_best": by_document(is_b), "count_sum": by_document(count), "n_best_a": by_document(is_a)}
    names = [f.split()[0] for f in RESULT.split(", ")]
    return pa.table({k: made[k] if k in made else docs[k] for k in names})


def aligned(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document, and n_best_a: links whose count is their A id's highest."""
    slices = sliced(docs, a, b)
    best = [(F.col("count") == F.col(f"best_{s}")).cast("long").alias(f"is_best_{s}") for s in "ab"]
    facts = slices.where("pair_no is not null").select("slice", "pair_no", "a", "b").join(pair_counts(slices), ["a", "b"]).select(F.col("slice").alias("of_slice"), "pair_no", "count", *best)
    rows = slices.where("pair_no is null").drop("pair_no", "a", "b", "links")
    return rows.groupBy("slice").cogroup(facts.groupBy("of_slice")).applyInArrow(tally, RESULT)


def groups(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES) -> DataFrame:
    """doc_id, group_no, a_ids, b_ids: the groups of each document's tokens, in order from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for batch in bounded(batches, 1, SLICE >> 4):
            for doc_id, text in zip(batch.column(0), strings(batch.column(1)), strict=True):
                found = own.whole(text)[0]
                ids = [pa.array([g[side] for g in found], pa.list_(pa.int32())) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), *ids], names=["doc_id", "group_no", "a_ids", "b_ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, group_no int, a_ids array<int>, b_ids array<int>")
