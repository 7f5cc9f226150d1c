"""Words and shingles of whole columns of text, as 64-bit hashes computed on byte buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A null text is empty. Memory is
bounded by SEGMENT bytes and the words of one Arrow batch, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
SHINGLE_WORDS = 5

_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCTUATION = ~_ALNUM & ~_SEPARATOR & (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)
_BASE = 0x9E3779B97F4A7C15
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what is computed from one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SEGMENT, n) + 1
    if size not in _tables:
        _tables.clear()
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _tables[size] = (both[0], both[1])
    return _tables[size]


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(sep: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Positions that split the bytes into segments without splitting a word."""
    cuts, n = [0], len(sep)
    while n - cuts[-1] > SEGMENT:
        lo, hi = cuts[-1], cuts[-1] + SEGMENT
        at = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
        if at <= lo:
            spaces = np.flatnonzero(sep[lo + 1 : hi])
            at = lo + 1 + int(spaces[-1]) if len(spaces) else 0
        if at <= lo:
            later = np.flatnonzero(sep[hi:])
            follow = int(offsets[min(np.searchsorted(offsets, hi), len(offsets) - 1)])
            at = min(hi + int(later[0]) if len(later) else n, follow)
        cuts.append(at)
        if at >= n:
            return cuts
    return [*cuts, n] if n else cuts


def word_spans(data: np.ndarray, offsets: np.ndarray, lower: bool = True, tails: bool = False, prefixes: tuple[int, ...] = ()):
    """Yields (starts, ends, hashes) of the words, segment by segment, in order.

    tails: a run of ASCII punctuation after an ASCII letter or digit at a word's end is a word of its own.
    prefixes: also yields, for each length in bytes, (numbers, hashes) of the words that are longer.
    """
    sep = _SEPARATOR[data]
    cuts = _cuts(sep, offsets)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        b, s = data[lo:hi], sep[lo:hi]
        b = _LOWER[b] if lower else b
        gap = np.concatenate([[True], s, [True]])
        first, last = ~s & gap[:-2], ~s & gap[2:]
        breaks = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi)] - lo
        first[breaks] = ~s[breaks]
        last[breaks - 1] = ~s[breaks - 1]
        if tails:
            solid = np.maximum.accumulate(np.where(_PUNCTUATION[b], 0, np.arange(hi - lo)))
            end = np.flatnonzero(last)
            p = solid[end]
            p = p[(p < end) & (p >= np.flatnonzero(first)) & _ALNUM[b[p]]]
            last[p] = first[p + 1] = True
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(hi - lo)
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum((b.astype(_U) + _U(1)) * up[: hi - lo], out=total[1:])
        size = ends - starts
        h = (total[ends] - total[starts]) * down[starts]
        found = (starts + lo, ends + lo, mix(h + size.astype(_U) * _U(0xD6E8FEB86659FD93)))
        if not prefixes:
            yield found
            continue
        heads = []
        for p in prefixes:
            at = np.flatnonzero(size > p)
            head = (total[starts[at] + p] - total[starts[at]]) * down[starts[at]]
            heads.append((at, mix(head + _U(p * 0x8CB92BA72F3D8DD7 % (1 << 64)))))
        yield (*found, heads)


def word_hashes(texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of each text's words)."""
    data, offsets = buffers(texts)
    parts = list(word_spans(data, offsets, lower))
    if not parts:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    starts = np.concatenate([p[0] for p in parts])
    return np.concatenate([p[2] for p in parts]), np.searchsorted(starts, offsets).astype(np.int64)


_STEP = [_U(pow(0xA0761D6478BD642F, i + 1, 1 << 64)) for i in range(64)]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position (n - 1 fewer than there are words)."""
    if len(words) < n:
        return np.zeros(0, _U)
    total = np.full(len(words) - n + 1, _U(n), _U)
    for j in range(n):
        total += words[j : j + len(total)] * _STEP[j]
    return mix(total)


def shingle_runs(words: np.ndarray, at: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes with repeats, offsets by text); a text of fewer than n words has one, of all its words."""
    grams, count = ngram_hashes(words, n), np.diff(at)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.zeros(offsets[-1], _U)
    long = np.flatnonzero(count >= n)
    where = np.repeat(at[long] - offsets[long], size[long]) + _within(offsets, long, size)
    out[_within(offsets, long, size)] = grams[where] if len(where) else grams[:0]
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            total = np.full(len(short), _U(m), _U)
            for j in range(m):
                total += words[at[short] + j] * _STEP[j]
            out[offsets[short]] = mix(total)
    return out, offsets


def _within(offsets: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions offsets[r] .. offsets[r] + size[r] of all rows, one after the other."""
    n = size[rows]
    return np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(rows) else np.zeros(0, np.int64)


def shingle_sets(texts, n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    runs, at = shingle_runs(*word_hashes(texts), n)
    return [np.unique(runs[a:b]) for a, b in zip(at, at[1:], strict=False)]
