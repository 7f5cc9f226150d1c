import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lm

SCHEMA = "doc_id long, text string, score string"
END, BEGIN = 0, 1


def texts(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [" ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randint(0, 30))) for _ in range(n)]


def plain_model(train, keep):
    """The same model with dictionaries: P(word | before)."""
    rows = [t.split() + [END] for t in train]
    single, pairs = Counter(w for r in rows for w in r), Counter(p for r in rows for p in zip([BEGIN, *r], r, strict=False))
    after = Counter(w for _, w in pairs)
    context, kept = Counter(), Counter()

    def discounts(counts):
        n = [sum(c == i for c in counts) for i in range(1, 5)]
        return lm.discounts(*n)

    d, e = discounts(pairs.values()), discounts(after.values())
    off = lambda c, ds: ds[min(c, 3) - 1]
    for (v, _), c in pairs.items():
        context[v] += c
        kept[v] += c - off(c, d) if c >= keep else 0
    total = sum(after.values())
    rest = sum(off(c, e) for c in after.values()) / total
    unknown = rest / (len(single) + 1)
    low = {w: (c - off(c, e)) / total + unknown for w, c in after.items()}

    def p(w, v):
        base = low.get(w, unknown)
        if v not in context:
            return base
        c = pairs[(v, w)]
        return (c - off(c, d) if c >= keep else 0) / context[v] + (1 - kept[v] / context[v]) * base

    return p, single, len(single)


@pytest.mark.parametrize("keep", [1, 2, 3])
def test_probabilities_equal_those_of_dictionaries_and_add_up_to_one(spark, keep):
    train = texts(1)
    m = lm.train(spark.createDataFrame([(i, t, "x") for i, t in enumerate(train)], SCHEMA).repartition(3), keep)
    p, single, v = plain_model(train, keep)
    assert (m.tokens, m.vocabulary) == (sum(single.values()), v)
    fresh = texts(2, 20) + ["new words here", "", "w1 unknown w1"]
    got = lm.log_probabilities(m, pa.array(fresh))
    for t, x, base, n, known in zip(fresh, *got, strict=True):
        row = t.split() + [END]
        assert n == len(row) and known == sum(w in single for w in row)
        assert math.isclose(x, sum(math.log10(p(w, b)) for b, w in zip([BEGIN, *row], row, strict=False)), rel_tol=1e-9)
        assert math.isclose(base, sum(math.log10((single[w] + 0.5) / (m.tokens + 0.5 * (v + 1))) for w in row), rel_tol=1e-9)
    for before in ("w0", "w7", BEGIN, "unseen"):
        assert math.isclose(sum(p(w, before) for w in single) + p("none", before), 1)


def test_query_and_edges(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(3))] + [(500, None, "x"), (501, "w1 " * 100_000, "x"), (None, "w2", "x"), (0, "again", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lm.held_out_scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    assert {r.n_tokens for r in got if r.doc_id == 500} == {1} and {r.n_tokens for r in got if r.doc_id == 501} == {100_001}
    assert len({r.train_tokens for r in got}) == 1
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.held_out_scores(docs.limit(0)).collect() == []


def test_no_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    m = lm.train(docs.limit(0))
    p, base, n, known = lm.log_probabilities(m, pa.array(["a b"]))
    assert (m.tokens, m.vocabulary, n[0], known[0]) == (0, 0, 3, 0) and p[0] == 0


def test_pairs_are_packed_in_six_bytes():
    x = np.array([0x123456789ABC0000, 0xFFFFFFFFFFFF0000], np.uint64)
    assert (lm._words(lm._six(x)) == x).all()


def test_pairs_seen_once_count(spark):
    train = spark.createDataFrame([(1, "a b c d"), (2, "a c b d"), (3, "a d d b")], "doc_id long, text string")
    m = lm.train(train)
    once, never = lm.log_probabilities(m, pa.array(["b c", "b b"]))[0]
    p = plain_model(["a b c d", "a c b d", "a d d b"], 1)[0]
    for t, x in (("b c", once), ("b b", never)):
        row = [*t.split(), END]
        assert math.isclose(x, sum(math.log10(p(w, b)) for b, w in zip([BEGIN, *row], row, strict=False)), rel_tol=1e-9)


def plain_triples(train, keep):
    """The model of order 3 with dictionaries: P(word | two before)."""
    rows = [t.split() + [END] for t in train]
    single = Counter(w for r in rows for w in r)
    triples = Counter(x for r in rows for x in zip([BEGIN, *r], r, r[1:], strict=False))
    starts = Counter((BEGIN, r[0]) for r in rows)
    pairs = Counter((v, w) for _, v, w in triples) + starts
    after = Counter(w for _, w in pairs)

    def off(counts, least):
        d = lm.discounts(*([sum(c == i for c in counts) for i in range(1, 5)]))
        return lambda c: d[min(c, 3) - 1] if c >= least else c

    o3, o2, o1 = off(triples.values(), keep), off(pairs.values(), 1), off(after.values(), 1)
    follow = sum(after.values())
    unknown = sum(map(o1, after.values())) / follow / (len(single) + 1)
    low = {w: (c - o1(c)) / follow + unknown for w, c in after.items()}

    def level(counts, o, lower):
        total, back = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            back[g[:-1]] += o(c)

        def p(*g):
            if g[:-1] not in total:
                return lower(*g[1:])
            c = counts.get(g, 0)
            return ((c - o(c) if c else 0) + back[g[:-1]] * lower(*g[1:])) / total[g[:-1]]

        return p

    two = level(pairs, o2, lambda w: low.get(w, unknown))
    return level(triples, o3, two), two, single


@pytest.mark.parametrize("keep", [1, 2])
def test_order_three_equals_dictionaries_and_adds_up_to_one(spark, keep):
    train = texts(4)
    m = lm.train(spark.createDataFrame([(i, t, "x") for i, t in enumerate(train)], SCHEMA).repartition(3), keep, order=3)
    three, two, single = plain_triples(train, keep)
    fresh = texts(5, 20) + train[:5] + ["new words here", "", "w1 unknown w1"]
    for t, x in zip(fresh, lm.log_probabilities(m, pa.array(fresh))[0], strict=True):
        row = [*t.split(), END]
        want = math.log10(two(BEGIN, row[0])) + sum(math.log10(three(*g)) for g in zip([BEGIN, *row], row, row[1:], strict=False))
        assert math.isclose(x, want, rel_tol=1e-6)
    for before in (("w0", "w1"), (BEGIN, "w0"), ("unseen", "w2")):
        assert math.isclose(sum(three(*before, w) for w in single) + three(*before, "none"), 1)


def test_order_is_a_parameter(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts(6))], SCHEMA)
    assert len(lm.held_out_scores(docs, order=3).collect()) == 120 and lm.held_out_scores(docs.limit(0), order=3).collect() == []
    with pytest.raises(ValueError):
        lm.train(docs, order=4)
