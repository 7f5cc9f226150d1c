"""Byte-level BPE by ranks: encoding with a segment tree over byte positions, and decoding.

Each match of the pattern is encoded by itself. A leaf of the tree stands for a byte position and holds the rank of the pair whose
left token begins there, a node the least of its two halves, the leftmost on ties. So the root names the pair to merge, and a merge
is three point updates of logarithmic length: the dead right neighbour, the merged token and its live neighbour before. A match
of n bytes takes O(n log n), however long it is.

Defined results: a null text is the empty text and has no ids. Strings of special tokens are ordinary text. Bytes that are no
UTF-8 are read as U+FFFD. Equal texts have equal ids; rows that share a doc_id stay separate rows and a null doc_id stays null. An empty
table gives an empty result. Other columns are ignored, whatever their names. Ranks that lack one of the 256 bytes are an error.
Memory: one text with its ids, and at most 2 * HALF encoded matches of CACHED bytes together.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.tiktoken"
HALF = 1 << 19
CACHED = 1 << 25
BATCH = 4 << 20
MATCHES = 1 << 16
LONG = 1 << 20
Ranks = dict[bytes, int]


def read_ranks(path: str) -> Ranks:
    """Token bytes -> rank, from lines of base64 bytes and a number."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} has no rank for the bytes {missing[:8]}")
    return ranks


class PairTree:
    """The leftmost pair of least rank among byte positions, under point updates."""

    def __init__(self, keys: list[int], none: int):
        self.size = 1 << max(0, len(keys) - 1).bit_length()
        self.least = least = [none] * (2 * self.size)
        least[self.size : self.size + len(keys)] = keys
        for k in range(self.size - 1, 0, -1):
            left, right = least[2 * k], least[2 * k + 1]
            least[k] = left if left < right else right

    def put(self, at: int, key: int) -> None:
        """Sets a leaf and the nodes above it, up to the first that stays as it is."""
        least = self.least
        k = self.size + at
        least[k] = key
        while k > 1:
            other = least[k ^ 1]
            if other < key:
                key = other
            k >>= 1
            if least[k] == key:
                return
            least[k] = key


def merge(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one match: its own rank if it has one, else what is left when no pair of neighbours has a rank."""
    own = ranks.get(piece)
    if own is not None:
        return [own]
    n = len(piece)
    none = (max(len(ranks), 1) << 64) * n  # above rank * n + position of any pair
    rank = ranks.get

    def key(begin: int, end: int) -> int:
        r = rank(piece[begin:end])
        return none if r is None else r * n + begin

    tree = PairTree([key(i, i + 2) for i in range(n - 1)], none)
    least, put = tree.least, tree.put
    ends, before = list(range(1, n + 1)), list(range(-1, n))
    while least[1] < none:
        left = least[1] % n
        right = ends[left]
        end = ends[right]
        ends[left], before[end] = end, left
        if right < n - 1:
            put(right, none)
        put(left, key(left, ends[end]) if end < n else none)
        if (first := before[left]) >= 0:
            put(first, key(first, end))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return out


class Matches(dict):
    """Match -> its ids as little-endian 32-bit integers; the last HALF distinct matches stay, older ones while they are met again."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks, self.older, self.held = ranks, {}, 0

    def __missing__(self, match: str) -> bytes:
        ids = self.older.get(match)
        if ids is None:
            ids = np.array(merge(match.encode("utf-8", "replace"), self.ranks), "<u4").tobytes()
        if len(self) >= HALF or self.held >= CACHED // 2:
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += len(match) + len(ids)
        self[match] = ids
        return ids


class Codec:
    """Encoding and decoding by one file of ranks and one pattern."""

    def __init__(self, ranks: Ranks, pattern: str):
        import regex

        self.pattern, self.known = regex.compile(pattern), Matches(ranks)
        self.tokens = {i: t for t, i in ranks.items()}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers; of a long text no more than MATCHES matches are held at a time."""
        known = self.known.__getitem__
        if len(text) <= LONG:
            return b"".join(map(known, self.pattern.findall(text)))
        found = (m.group() for m in self.pattern.finditer(text))
        return b"".join(iter(lambda: b"".join(map(known, islice(found, MATCHES))), b""))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens, one after the other."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str | None], Codec] = {}


def codec(tokenizer: str = TOKENIZER, pattern: str | None = None) -> Codec:
    """This process's codec of a public tokenizer's file of ranks; its place is asked for where it is used, since machines differ."""
    import public_tokenizers

    if (tokenizer, pattern) not in _codecs:
        _codecs[tokenizer, pattern] = Codec(read_ranks(public_tokenizers.path(tokenizer)), pattern or public_tokenizers.PATTERN)
    return _codecs[tokenizer, pattern]


def strings(column: pa.Array) -> list[str]:
    """A text column as strings, nulls as empty ones."""
    return [x.decode("utf-8", "replace") if x else "" for x in column.cast(pa.binary()).to_pylist()]


def bounded(batches: Iterator[pa.RecordBatch], column: int, size: int = BATCH, rows: int = 1 << 12) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column has at most ``size`` bytes, or one row, and at most ``rows`` rows."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > begin and (held + n > size or i - begin >= rows):
                yield b.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if b.num_rows > begin:
            yield b.slice(begin)


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def encode_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, pattern: str | None) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, ids)."""
    own = codec(tokenizer, pattern)
    for b in bounded(batches, 1):
        yield pa.RecordBatch.from_arrays([b.column(0), _binary([own.encode(t) for t in strings(b.column(1))])], names=["doc_id", "ids"])


def decode_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, pattern: str | None) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) -> (doc_id, ids, decoded)."""
    own = codec(tokenizer, pattern)
    for b in batches:
        decoded = [own.decode(x) if x else b"" for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(decoded)], names=["doc_id", "ids", "decoded"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """doc_id, ids: the ids of each text as little-endian unsigned 32-bit integers."""
    return _texts(docs).mapInArrow(lambda batches: encode_batches(batches, tokenizer, pattern), "doc_id long, ids binary")


def decoded(ids: DataFrame, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: the bytes that the ids of encoded() stand for. Null ids stand for none."""
    return ids.select("doc_id", "ids").mapInArrow(lambda batches: decode_batches(batches, tokenizer, pattern), "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text, encoded and decoded in one pass over the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decode_batches(encode_batches(batches, tokenizer, pattern), tokenizer, pattern)

    return (
        _texts(docs)
        .mapInArrow(run, "doc_id long, ids binary, decoded binary")
        .select(
            "doc_id",
            (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
            F.sha2("ids", 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256"),
        )
    )
