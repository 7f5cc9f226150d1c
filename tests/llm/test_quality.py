import random
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard

from tessera.llm import labelled, quality

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classified(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([r.predicted for r in good]) > 0.9 and np.mean([r.predicted for r in bad]) < 0.4
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([[a.score > b.score for b in bad] for a in good]) > 0.9


def test_held_out_accuracy_of_more_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(labelled.fold(5) == 0)
    model = quality.fit(docs, labels)
    rows = quality.scored(docs.join(held.select("doc_id"), "doc_id"), model).join(held, "doc_id").collect()
    good, bad = ([r.score >= quality.THRESHOLD for r in rows if r.quality == q] for q in (1, 0))
    assert len(bad) > 100 and np.mean(bad) <= 0.07 and np.mean(good) >= 0.98


def sizes(text, words):
    """Compressed size of a text's blocks by the library alone."""
    c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_dict_id=False) if words else zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False)
    raw = (text or "").encode()
    return sum(len(c.compress(raw[i : i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK))


def pooled(x, y):
    """The curve by looking for the first fall again and again."""
    prior = (y.sum() + 1) / (len(y) + 2)
    pools = [([a] * n, [b for z, b in zip(x.tolist(), y.tolist(), strict=True) if z == a]) for a, n in sorted(Counter(x.tolist()).items())]
    share = lambda p: sum(p[1]) / len(p[1])
    while falls := [i for i in range(len(pools) - 1) if share(pools[i]) >= share(pools[i + 1])]:
        i = falls[0]
        pools[i : i + 2] = [(pools[i][0] + pools[i + 1][0], pools[i][1] + pools[i + 1][1])]
    return [sum(p[0]) / len(p[0]) for p in pools], [(sum(p[1]) + prior) / (len(p[1]) + 1) for p in pools]


def test_measures_and_curve_equal_plain_loops():
    rng = random.Random(3)
    clean = [" ".join(rng.choice(["plain", "words", "of", "a", "longer", "text", str(i)]) for _ in range(rng.randrange(1, 400))) for i in range(60)]
    noise = ["".join(rng.choice("!#$%") for _ in range(rng.randrange(1, 900))) for _ in range(25)]
    texts, y = [*clean, *noise, "", ""], np.array([1] * 60 + [0] * 25 + [0, 1])
    model = quality.learn(pa.table({"doc_id": range(len(texts)), "y": y, "text": texts}))
    x, seen = [], {0: 0, 1: 0}
    part = []
    for k in y.tolist():
        part.append(seen[k] % quality.PARTS)
        seen[k] += 1
    for t, p in zip(texts, part, strict=True):
        others = {k: [o.encode() for o, q, label in zip(texts, part, y, strict=True) if q != p and label == k and o] for k in (0, 1)}
        x.append((sizes(t, quality.dictionary(others[0])) - sizes(t, quality.dictionary(others[1]))) / max(1, len(t.encode())))
    knots, shares = pooled(np.array(x), y)
    assert np.allclose(model.knots, knots) and np.allclose(model.shares, np.maximum.accumulate(shares))
    fresh = [*texts, None, "new words " * 500, "é" * 3000]
    want = [(sizes(t, model.bad) - sizes(t, model.good)) / max(1, len((t or "").encode())) for t in fresh]
    got = quality.measures(pa.array(fresh), quality.compressor(model.good), quality.compressor(model.bad))
    assert np.allclose(got, want)


def test_the_fit_is_that_of_the_sample(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = labelled.sample(docs, labels, "quality", 5, 0).toPandas().sort_values("doc_id")
    one, two = quality.learn(pa.Table.from_pandas(rows, preserve_index=False)), quality.fit(docs, labels)
    assert (one.good, one.bad) == (two.good, two.bad) and np.allclose(one.knots, two.knots) and np.allclose(one.shares, two.shares)


def test_repeated_words_are_bad_when_such_labels_were_seen(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    clean = [" ".join(rng.choices(words, k=rng.randrange(80, 300))) for _ in range(120)]
    repeated = [" ".join(f"{w} " * rng.randrange(20, 60) for w in rng.choices(words, k=3)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(clean + repeated)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(200)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classified(docs, labels).collect()}
    assert np.mean([got[i].predicted for i in range(120)]) > 0.95 and np.mean([got[i].predicted for i in range(120, 200)]) < 0.1


def test_nulls_empty_long_and_clashing_columns(spark):
    text = "plain words of a text "
    rows = [(i, text + str(i), 9) for i in range(40)] + [(100 + i, f"!!{i}!!" * 30, 9) for i in range(40)] + [(None, None, 9), (7, "", 9), (8, "x" * 300_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id between 100 and 140").count() < 10 <= kept.where("doc_id < 40").count()


def test_one_class_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.classified(docs, none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert len({r.score for r in quality.classified(docs, one).collect()}) == 1
    assert quality.classified(docs.limit(0), none).collect() == []


def test_calibration_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-3 * x))).astype(int)
    knots, shares = labelled.isotonic(x, y)
    assert list(knots) == sorted(knots) and list(shares) == sorted(shares)
    assert abs(np.interp(x, knots, shares).mean() - y.mean()) < 0.02
