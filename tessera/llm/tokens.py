"""Token ids of whole columns of text by a public tokenizer, one encoding for each distinct word.

Every step of the tokenizers served here stops at ASCII white space, so the ids of a text are those of
its white-space separated words, one after the other. The default tokenizer also lower-cases letters and
parts letters and digits from punctuation, so it meets fewer distinct words (``parts``); not so where a special
token's mark occurs. A null text has no ids. The word cache holds at
most CACHE words and starts anew beyond that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm.text import buffers, word_spans

CACHE = 1 << 20
NARROW = 1 << 16
TOKENIZER = "word_bpe_49k.json"
_held: dict[str, "WordEncoder"] = {}


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.parts = path.endswith(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used, self.keyed = np.zeros(1 << 16, np.int32), 0, None

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        found = [e.ids for at in range(0, len(words), 8192) for e in encode(words[at : at + 8192], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int32, len(found))
        total = int(size.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), total), np.int32)])
        self.ids[self.used : self.used + total] = np.fromiter((i for e in found for i in e), np.int32, total)
        start = self.used + np.cumsum(size) - size
        self.used += total
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.size = (np.insert(a, at, b) for a, b in ((self.keys, keys), (self.start, start), (self.size, size)))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        data, offsets = buffers(texts)
        ids, counts = [], np.zeros(len(offsets) - 1, np.int64)
        parts = self.parts and b"<|" not in data.tobytes()
        if self.keyed != parts:  # hashes of the two kinds don't mix
            self.clear()
            self.keyed = parts
        for starts, ends, hashes in word_spans(data, offsets, lower=parts, tails=parts):
            keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
            if new.any():
                if len(self.keys) + new.sum() > CACHE:
                    self.clear()
                    new[:] = True
                    self.keyed = parts
                raw = data.data
                words = [bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(starts[first[new]], ends[first[new]], strict=True)]
                self._learn(keys[new], words)
                at = np.searchsorted(self.keys, keys)
            at = at[inverse]
            n, s = self.size[at].astype(np.int64), self.start[at]
            end = np.cumsum(n)
            ids.append(self.ids[np.repeat(s - end + n, n) + np.arange(end[-1] if len(end) else 0)])
            counts += np.bincount(np.searchsorted(offsets, starts, "right") - 1, n, len(counts)).astype(np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(counts)])


def encoder(path: str) -> WordEncoder:
    """The encoder of this process."""
    if path not in _held:
        _held[path] = WordEncoder(path)
    return _held[path]


def token_path(name: str = TOKENIZER) -> str:
    """Where the named public tokenizer lies; asked for where it is used, since machines differ."""
    import public_tokenizers

    return public_tokenizers.path(name)


def width(tokenizer: str, end: int | None = None) -> int:
    """Bytes that any id of the named tokenizer, and ``end``, takes: two, or four where ids go beyond NARROW."""
    most = max(encoder(token_path(tokenizer)).tokenizer.get_vocab_size(with_added_tokens=True) - 1, end or 0)
    return 2 if most < NARROW else 4


def as_arrow(ids: np.ndarray, offsets: np.ndarray, size: int = 2) -> pa.Array:
    """Ids as one binary value a text, little-endian, ``size`` bytes an id."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids.astype(f"<u{size}")))])


def as_ids(raw, n: int) -> np.ndarray:
    """The n ids of a value of as_arrow()."""
    return np.frombuffer(raw, f"<u{len(raw) // n}") if n else np.zeros(0, "<u2")
