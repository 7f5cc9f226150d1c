import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, tokens string, kept int"


def rows(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = ["en", "fr", None][rng.choice(3, p=[0.7, 0.2, 0.1])]
        text = "word " * int(rng.integers(1, 40)) + ["", " | x", "a@b", "12345 " * 30][rng.choice(4, p=[0.7, 0.1, 0.1, 0.1])]
        out.append((i, text, lang, f"s{int(rng.integers(0, 9)) // 3}" if rng.random() < 0.6 else "s0", "own", 7))
    return out


@pytest.mark.parametrize("small", [20_000, 0])
def test_weights_equal_those_of_plain_loops(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "SMALL", small)
    monkeypatch.setattr(mixing, "ROUNDS", 4)
    cells = [(s, lang, t, int(n)) for (s, lang, t), n in np.ndenumerate(np.random.default_rng(1).integers(1, 900, (4, 3, 2)))]
    table = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", n) for a, b, c, n in cells], "source string, lang string, topic string, tokens long")
    targets = {"source": {"s0": 1, "s1": 1, "s2": 1, "s3": 1}}
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(table, targets, 4).collect()}
    w = np.zeros((4, 3, 2))
    for a, b, c, n in cells:
        w[a, b, c] = n
    total, w = w.sum(), w / w.sum()
    goals = [np.full(4, 0.25)]
    for axes in ((0, 2), (0, 1)):
        g = (w * total).sum(axes) ** mixing.TEMPER
        goals.append(g / g.sum())
    for _ in range(mixing.ROUNDS):
        for d, g in enumerate(goals):
            others = tuple(x for x in range(3) if x != d)
            w = w * (g / w.sum(others)).reshape([-1 if x == d else 1 for x in range(3)])
    for (a, b, c), x in np.ndenumerate(w):
        assert abs(got[f"s{a}", f"l{b}", f"t{c}"] - x * total) < 1e-6 * total
    for d, g in enumerate(goals):
        assert np.abs(w.sum(tuple(x for x in range(3) if x != d)) - g).max() < 0.02


def test_sample_meets_its_fraction_and_targets(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = mixing.mixed(docs, {"source": {"s0": 1, "s1": 1, "s2": 1}}, fraction=0.3)
    sums = out.groupBy("source").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("probability")).alias("e"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("k")).collect()
    every = sum(r.t for r in sums)
    assert abs(sum(r.e for r in sums) / every - 0.3) < 0.01 and abs(sum(r.k for r in sums) / every - 0.3) < 0.04
    shares = [r.e / sum(x.e for x in sums) for r in sums]
    assert max(shares) - min(shares) < 0.05
    kept = mixing.sampled(docs, fraction=0.3)
    assert kept.columns == docs.columns and {r["tokens"] for r in kept.collect()} == {"own"}


def test_many_cells_take_the_other_join(spark, monkeypatch):
    docs = spark.createDataFrame(rows(400), SCHEMA)
    a = {r.doc_id: r.probability for r in mixing.mixed(docs, rounds=2).collect()}
    monkeypatch.setattr(mixing, "SMALL", 0)
    b = {r.doc_id: r.probability for r in mixing.mixed(docs, rounds=2).collect()}
    assert len(a) == 400 and all(abs(b[k] - p) < 1e-9 for k, p in a.items())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, "", 1), (1, None, None, None, "", 1), (None, "x", "en", "s", "", 1), (3, "y " * 100_000, "en", "s", "", 1)], SCHEMA)
    out = mixing.mixed(docs).collect()
    assert len(out) == 4 and len({r.kept for r in out if r.doc_id == 1}) == 1 and sorted(r.tokens for r in out) == [0, 0, 1, 100_000]
    assert all(r.probability is not None for r in out)
    assert mixing.mixed(docs.limit(0)).collect() == []


def test_topics(spark):
    texts = {"a | b": "listing", "me@home": "contact", "12345": "figures", "LOUD TEXT": "shouting", "quiet": "prose", "": "prose"}
    got = {r.t: r.topic for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.topic_of(F.col("t")).alias("topic")).collect()}
    assert got == texts


def test_expected_shares_of_all_marginals_meet_their_goals(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = mixing.mixed(docs, {"source": {"s0": 1, "s1": 2, "s2": 1}}, fraction=0.5)
    report = mixing.marginals(docs, {"source": {"s0": 1, "s1": 2, "s2": 1}}, fraction=0.5).collect()
    every = out.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
    assert abs(every[1] / every[0] - 0.5) < 1e-3 and out.where("probability > 1").isEmpty()
    seen = {(d, r[0]): r[1:] for d in mixing.DIMENSIONS for r in out.groupBy(d).agg(F.sum(F.col("tokens") * F.col("probability")), F.sum("tokens")).collect()}
    assert len(report) == len(seen) and len({r.dimension for r in report}) == 3
    short = 0
    for r in report:
        kept, has = seen[r.dimension, r.value]
        assert abs(kept / every[1] - r.goal) < 1e-3 and abs(r.expected - r.goal) < 1e-3
        if r.goal < r.target - 1e-3:  # gives all that it has
            short += 1
            assert kept > 0.998 * has
    assert short


def test_targets_are_met_where_there_are_tokens(spark):
    docs = spark.createDataFrame(rows(seed=2), SCHEMA)
    for r in mixing.marginals(docs, fraction=0.3).collect():
        assert abs(r.expected - r.target) < 1e-3 and abs(r.goal - r.target) < 1e-9


def test_goals_that_contradict_each_other_warn_and_missing_sources_are_ignored(spark):
    data = [(i, "word " * 10, "en" if i < 50 else "fr", "a" if i < 50 else "b", "", 0) for i in range(100)]
    docs = spark.createDataFrame(data, SCHEMA)
    with pytest.warns(UserWarning, match="don't agree"):
        out = mixing.mixed(docs, {"source": {"a": 0.9, "b": 0.1, "nobody": 4.0}, "lang": {"en": 0.1, "fr": 0.9}}, fraction=0.3).collect()
    assert len(out) == 100 and all(0 <= r.probability <= 1 for r in out)
    out = mixing.mixed(docs, {"source": {"a": 0.75, "b": 0.25, "nobody": 4.0}, "lang": {"en": 0.75, "fr": 0.25}}, fraction=0.3).groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("e"))
    got = {r.source: r.e for r in out.collect()}
    assert abs(got["a"] / (got["a"] + got["b"]) - 0.75) < 1e-3


def test_a_named_topic_column(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 5), "en", "s", "t" + str(i % 3), 0) for i in range(90)], SCHEMA)
    report = [r for r in mixing.marginals(docs, {"topic": {"t0": 1, "t1": 1, "t2": 2}}, fraction=0.3, topic="tokens").collect() if r.dimension == "topic"]
    assert sorted((r.value, round(r.target, 6)) for r in report) == [("t0", 0.25), ("t1", 0.25), ("t2", 0.5)]
    assert all(abs(r.expected - r.target) < 1e-3 for r in report)
