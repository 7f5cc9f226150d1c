import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import text as T


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("segment", [7, 64, 1 << 20])
def test_words_and_shingles_equal_those_of_a_plain_pattern(segment, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", segment)
    T._tables.clear()
    rng = random.Random(segment)
    texts = [None, "", "a", "  ", "Abc abc", "é É\x0bx\ny"] + ["".join(rng.choice("aB \n\té") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    hashes, at = T.word_hashes(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        assert at[i + 1] - at[i] == len(words(t))
        for w, h in zip(words(t), hashes[at[i] : at[i + 1]], strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    known = {}
    for t, s in zip(texts, T.shingle_sets(pa.array(texts)), strict=True):
        w = words(t)
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert len(grams) == len(s) and known.setdefault(frozenset(grams), tuple(s)) == tuple(s)
    T._tables.clear()


def test_sliced_and_large_columns():
    column = pa.array(["one two", None, "three"])
    a = T.word_hashes(column.slice(1))
    b = T.word_hashes(pa.array([None, "three"], pa.large_string()))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and len(T.word_hashes(pa.array([], pa.string()))[0]) == 0


def test_prefixes_are_of_longer_words_only():
    data, offsets = T.buffers(pa.array(["loweiä loweix low, lowei"]))
    ((_, _, h, heads),) = list(T.word_spans(data, offsets, tails=True, prefixes=(5,)))
    at, prefix = heads[0]
    assert len(h) == 5 and at.tolist() == [0, 1] and prefix[0] == prefix[1] and np.uint64(0) != prefix[0]
