import numpy as np

from tessera.llm import toxicity

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classified(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r for r in rows if r.toxic == q] for q in (1, 0))
    assert np.mean([r.predicted for r in toxic]) > 0.85 and np.mean([r.predicted for r in clean]) < 0.02


def test_factors_learn_pairs(spark):
    """Neither word alone is toxic, both together are."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(1200):
        a, b = rng.random(2) < 0.5
        filler = " ".join(f"w{x}" for x in rng.integers(0, 40, 12))
        rows.append((i, filler + " insult" * int(a) + " people" * int(b)))
        labels.append((i, int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert np.abs(model.factors).max() > 0.1
    truth = dict(labels)
    got = toxicity.scored(docs, model).collect()
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in got]) > 0.97


def test_margin_is_the_sum_over_pairs():
    m = toxicity.Model(np.arange(3), 0.5, np.array([1.0, 2.0, -1.0]), np.array([[1.0, 0.0], [0.5, 2.0], [3.0, 1.0]]))
    got = toxicity.margins(np.array([0, 0, 1]), np.array([0, 2, 1]), 3, m)
    assert np.allclose(got, [0.5 + 1 - 1 + 3.0, 0.5 + 2, 0.5])


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 1), (3, "a " * 100_000, 1)], "doc_id long, text string, predicted int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.classified(docs, none).collect()] == [0.5] * 3
    assert toxicity.classified(docs.limit(0), none).collect() == []
    assert toxicity.accepted(docs, toxicity.fit(docs, none)).columns == docs.columns


def test_words_that_tell_nothing_by_themselves(spark):
    """Toxic with just one of two words: neither has a marginal effect, so only their pair can bring them in."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(1600):
        a, b = rng.random(2) < 0.5
        rows.append((i, " ".join(f"w{x}" for x in rng.integers(0, 40, 12)) + " insult" * int(a) + " people" * int(b)))
        labels.append((i, int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = dict(labels)
    got = toxicity.scored(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in got]) > 0.97


def test_the_sample_is_the_first_by_hash_and_does_not_depend_on_places(spark):
    from pyspark.sql import functions as F

    from tessera.llm import labelled

    docs = spark.createDataFrame([(i // 2, f"t{i % 3} " * (40_000 if i == 6 else 1)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i // 2, i % 2) for i in range(80)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    a, b = ({(r.doc_id, r.y, r.text) for r in labelled.sample(d, labels, "toxic", 4, 2, 10).collect()} for d in (docs, docs.repartition(7)))
    hashed = docs.select("doc_id", F.xxhash64("doc_id").alias("h"), labelled.fold(4).alias("f")).distinct().where("f <> 2").orderBy("h").limit(10).collect()
    assert a == b and {x[0] for x in a} == {r.doc_id for r in hashed} and {x[1] for x in a} == {1}
    whole = labelled.sample(docs, labels, "toxic", 1, 5, 100).where("doc_id = 3").first()
    assert len(whole.text) == min((120_000, "t0 " * 40_000), (3, "t1 "), key=lambda x: x[1])[0]
