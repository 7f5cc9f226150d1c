import hashlib

import numpy as np
import pyarrow as pa

from tessera.llm import fingerprint as f

SCHEMA = "doc_id long, text string, fingerprint string, extra int"


def edited(docs):
    out = []
    for i, (_, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1]
        out.append(t[: len(t) - len(t) // 2] + nxt[: len(t) // 2])
    return out


def test_edited_texts_follow_the_order_of_ids(spark):
    rng = np.random.default_rng(0)
    docs = [(int(i) * 7 - 50, " ".join(f"w{x}é" for x in rng.integers(0, 30, rng.integers(0, 90)))) for i in range(150)]
    docs[3] = (docs[3][0], "")
    rows = [(k, t or None, "x", 1) for k, t in docs]
    rng.shuffle(rows)
    table = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    table = table.withColumn("doc_id", table.doc_id.cast("long"))
    got = {r.doc_id: r for r in f.edited_fingerprints(table).collect()}
    for (k, t), e, (_, follow) in zip(docs, edited(docs), docs[1:] + docs[:1], strict=True):
        a, b, c = f.sketches(pa.array([t, e, follow]))
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert got[k].fingerprint == f.encode(a) and got[k].edited_fingerprint == f.encode(b)
        assert got[k].near_edited == f.likeness(a, b) and got[k].near_next == f.likeness(a, c)
        assert got[k].contained_edited == f.containment(a, b) and got[k].contained_next == f.containment(a, c)


def test_one_row_repeats_nulls_and_no_rows(spark):
    one = f.edited_fingerprints(spark.createDataFrame([(1, "a b", "", 0)], SCHEMA)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"a a").hexdigest() and one[0].n_chars == 3
    many = f.edited_fingerprints(spark.createDataFrame([(1, "x y z", "", 0)] * 3 + [(None, None, "", 0)], SCHEMA)).collect()
    assert len(many) == 4 and sum(r.near_next == 1 for r in many) >= 2
    assert f.edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketches_merge_and_estimate_containment():
    words = [f"word{i}" for i in range(4000)]
    small, large = " ".join(words[:400]), " ".join(words)
    a, b, both = f.sketches(pa.array([small, large, small + " " + large]))
    assert f.containment(a, b) == 1.0 and abs(f.containment(b, a) - 0.1) < 0.04
    assert (f.merge(a, a)[1] == a[1]).all() and (f.merge(a, b)[1] == both[1]).all()
    assert f.decode(f.encode(a))[0] == a[0] and (f.decode(f.encode(a))[1] == a[1]).all()


def test_column_of_the_same_name_is_replaced(spark):
    rows = f.fingerprints(spark.createDataFrame([(1, None, "old", 5)], SCHEMA)).collect()
    assert rows[0].fingerprint == "0:" and rows[0].extra == 5


def test_search_for_buckets(spark):
    from pyspark.sql import functions as F

    bounds = [-5, 0, 3, 3_000_000_000]
    got = spark.createDataFrame([(x,) for x in (-9, -5, 2, 3, 4, 3_000_000_000, 4_000_000_000)], "k long").select(f.bucket_of(F.col("k"), bounds)).collect()
    assert [r[0] for r in got] == [0, 1, 2, 3, 3, 4, 4]


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_short_texts_are_exact_and_long_ones_near_brute_force():
    rng = np.random.default_rng(4)
    texts = ["", "Red apples", "blue sky", "red  apples", "a b c d e f"] + [" ".join(f"w{x}" for x in rng.integers(0, 4, rng.integers(1, 60))) for _ in range(60)]
    sets, own = [shingles(t) for t in texts], f.sketches(pa.array(texts))
    for a, x in zip(sets, own, strict=True):
        for b, y in zip(sets, own, strict=True):
            assert f.likeness(x, y) == (len(a & b) / len(a | b) if a | b else 1.0) and f.containment(x, y) == (len(a & b) / len(a) if a else 0.0)
            assert f.encode(f.merge(x, y)) == f.encode(f.sketch(len(a | b), np.union1d(x[1], y[1])))
    base = [f"v{i}" for i in range(3000)]
    long = [" ".join(base[i : i + n]) for i, n in ((0, 3000), (500, 2500), (0, 70), (100, 300), (2900, 100), (0, 50))]
    sets, own = [shingles(t) for t in long], f.sketches(pa.array(long))
    for a, x in zip(sets, own, strict=True):
        for b, y in zip(sets, own, strict=True):
            assert abs(f.likeness(x, y) - len(a & b) / len(a | b)) < 4 / len(a | b) ** 0.5 and (f.likeness(x, y) == 1) == (a == b)
            assert abs(f.containment(x, y) - len(a & b) / len(a)) < 4 / len(a) ** 0.5


def test_a_long_text_without_a_hash_below_the_threshold_keeps_its_least():
    high = np.arange(1, 101, dtype=np.uint64) + (np.uint64(1) << np.uint64(63))
    other = high + np.uint64(500)
    a, b = f.sketch(100, high), f.sketch(100, other)
    assert len(a[1]) == len(b[1]) == 1 and f.likeness(a, b) == 0.0 and f.likeness(a, a) == 1.0


def test_many_buckets_and_a_very_long_text(spark):
    rows = [(i, f"text number {i} " * (1 if i else 60_000), "x", 1) for i in range(300)]
    out = f.with_next(spark.createDataFrame(rows, SCHEMA), "doc_id", ["text"], 100)
    halos = sorted((r._bucket, r.doc_id) for r in out.where("_halo = 1").collect())
    firsts = dict(sorted(((r._bucket, r.doc_id) for r in out.where("_halo = 0").collect()), reverse=True))
    assert halos == sorted((b, firsts.get(b + 1, firsts[0])) for b in firsts)
    got = {r.doc_id: r for r in f.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].n_chars == len(rows[0][1]) and got[299].contained_next == 0.0 and got[298].near_next == 0.0
