import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string, whitened long"


def made(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], SCHEMA).repartition(parts)


def integers(vectors):
    return [[math.floor(Fraction(1024 * c) if abs(c) < 1e300 else 1024 * Fraction(c)) + 100_000 for c in v] for v in vectors]


def covariance(x):
    n, k = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(k)]
    return [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3) for j in range(k)] for i in range(k)], sums


def check(got, vectors, components=8):
    """Against exact fractions: deviations, unit eigenvectors by their equation, whitened values and their covariance."""
    x = integers([v for _, v in vectors])
    n, k = len(x), min(components, len(x[0]))
    v, sums = covariance(x)
    rows = sorted((r for r in got), key=lambda r: (r.vec_id, r.component))
    assert len(rows) == n * k and {r.n for r in rows} == {n}
    by = {(r.vec_id, r.component): r for r in rows}
    trace = sum(v[i][i] for i in range(len(v)))
    plain = np.array([[float(c) for c in r] for r in v])
    values, axes = np.linalg.eigh(plain)
    for c in range(1, k + 1):
        e, axis = values[-c], axes[:, -c]
        w = np.array([by[i, c].whitened for i, _ in vectors])
        want = np.array([float(sum(Fraction(n * a - s, n) * Fraction(float(b)) for a, s, b in zip(r, sums, axis, strict=True))) for r in x]) / math.sqrt(e)
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-8 * max(1, np.abs(want).max())
        assert all(math.isclose(by[i, c].explained, e / float(trace), rel_tol=1e-9) for i, _ in vectors)
    for (i, _), r in zip(vectors, x, strict=True):
        deviation = sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))
        assert by[i, 1].deviation == (deviation if deviation < 1 << 63 else None)
    table = np.array([[by[i, c].whitened for i, _ in vectors] for c in range(1, k + 1)])
    error = np.abs(np.cov(table, bias=True).reshape(k, k) - np.eye(k)).max()
    assert all(r.identity_error <= 1e-4 and abs(r.identity_error - error) < 1e-9 for r in rows)


def random_vectors(seed, n, k, scale=1.0, mean=0.0):
    rng = np.random.default_rng(seed)
    mixing = rng.normal(size=(k, k))
    return [(i, (rng.normal(size=k) @ mixing * scale + mean).tolist()) for i in range(n)]


@pytest.mark.parametrize(("k", "scale", "mean"), [(12, 1.0, 0.0), (5, 0.01, 0.0), (9, 1.0, 1e6), (10, 1e5, -1e7)])
def test_equals_exact_fractions(spark, k, scale, mean):
    vectors = random_vectors(k, 60, k, scale, mean)
    check(whitening.whitened(made(spark, vectors)).collect(), vectors)


def test_order_and_partitions_change_no_bit(spark):
    vectors = random_vectors(3, 80, 10)
    first = sorted(map(tuple, whitening.whitened(made(spark, vectors, 1)).drop("identity_error").collect()))
    assert sorted(map(tuple, whitening.whitened(made(spark, vectors[::-1], 7)).drop("identity_error").collect())) == first


def test_rows_that_do_not_remain_and_repeats(spark):
    good = random_vectors(1, 30, 4)
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0]), (92, [1.0, float("nan"), 2.0, 3.0]), (93, [1.0, float("inf"), 2.0, 3.0]), (94, []), (95, [1.0, 2.0]), (96, [float("-inf")] * 4)]
    check(whitening.whitened(made(spark, good + bad)).collect(), good)
    twice = whitening.whitened(made(spark, [*good, good[0], good[0], (None, good[1][1])]))
    assert twice.count() == 33 * 4 and twice.where("vec_id = 0").count() == 12 and twice.where("vec_id is null").count() == 4
    assert {r.n for r in twice.select("n").distinct().collect()} == {33}


def test_vectors_without_variance(spark):
    got = whitening.whitened(made(spark, [(i, [0.5, 1.0]) for i in range(4)])).collect()
    assert len(got) == 8 and all(r.whitened is None and r.explained == 0 and r.identity_error == 0 and r.deviation == 0 for r in got)
    line = whitening.whitened(made(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and all(r.identity_error < 1e-9 for r in line)
    assert whitening.whitened(made(spark, [(1, [2.0])])).first().deviation == 0


def test_empty_tables(spark):
    for vectors in ([], [(1, None), (2, [])]):
        got = whitening.whitened(made(spark, vectors))
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_entries_beyond_a_long_and_deviations_beyond_one(spark):
    vectors = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [3.0, 2.0]), (3, [9.0e15, -1.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whitened(made(spark, vectors)).collect()}
    assert len(got) == 8 and got[0, 1].deviation is None and got[0, 1].identity_error < 1e-4
    x = whitening.whole(np.array([[1e300, -1e300, 2.0**52, 9007199254740991.0]]))
    assert x.tolist() == [[2**63 - 1, -(2**63), 2**62 + 100_000, 1024 * 9007199254740991 + 100_000 if 1024 * 9007199254740991 < 2**63 - 100_000 else 2**63 - 1]]


def test_scatter_is_exact_for_any_longs():
    rng = random.Random(2)
    for bits in (5, 20, 33, 62, 63):
        x = np.array([[rng.randrange(-(1 << bits), 1 << bits) for _ in range(4)] for _ in range(3000)], np.int64)
        s = whitening.Scatter(4)
        s.add(x)
        d = [[1, *(int(v) - whitening.SHIFT for v in r)] for r in x.tolist()]
        want = [[sum(r[i] * r[j] for r in d) for j in range(5)] for i in range(5)]
        assert s.sums.tolist() == want
        i, j, digits = s.digits()
        assert all(sum(v << (32 * k) for k, v in enumerate(digit)) == want[a][b] for a, b, digit in zip(i, j, digits, strict=True))


def test_floats_keep_their_own_value(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(50)
    vectors = [(r.vec_id, list(map(float, r.embedding))) for r in rows.collect()]
    check(whitening.whitened(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect(), vectors)
