import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import folds, model, ridge


def made(spark, n=90, seed=0, mean=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) + mean
    y = x @ [2.0, -1.0, 0.5] + 4 + rng.normal(size=n)
    return spark.createDataFrame([(i, i % 10, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, t int, a double, b double, c double, y double")


FEATURES = ["a", "b", "c"]


@pytest.mark.parametrize("mean", [0.0, 1e4])
def test_all_folds_and_penalties_equal_a_fit_each(spark, mean):
    df = made(spark, mean=mean)
    assigned = folds.assign(df, "t", folds.expanding(10, 3, 2, 1)).repartition(3)
    got = {(r.fold_id, r.alpha): r for r in ridge.coefficients(assigned, "y", FEATURES).collect()}
    assert len(got) == 15
    for f in range(3):
        train = assigned.where(f"fold_id = {f} and role = 'train'")
        rows = np.array([tuple(r) for r in train.select(*FEATURES, "y").collect()])
        x, y = rows[:, :3] - rows[:, :3].mean(0), rows[:, 3] - rows[:, 3].mean()
        for a in ridge.ALPHAS:
            want = np.linalg.solve(x.T @ x + a * np.eye(3), x.T @ y)
            assert np.allclose(got[f, a].w, want, atol=1e-8)
            assert abs(got[f, a].intercept - (rows[:, 3].mean() - rows[:, :3].mean(0) @ want)) < 1e-6 * max(1, mean)
    spark_fit = model.ridge(assigned.where("fold_id = 2 and role = 'train'"), "y", FEATURES, 10.0).stages[-1]
    assert np.allclose(got[2, 10.0].w, spark_fit.coefficients.toArray(), atol=1e-8 if not mean else 1e-5)


def test_parted_folds_equal_crossed_ones(spark):
    df = folds.kfold(made(spark), "id", 4)
    one = ridge.coefficients(df, "y", FEATURES, parted=True).collect()
    crossed = folds.crossed(df, 4)
    two = {(r.fold_id, r.alpha): r for r in ridge.coefficients(crossed, "y", FEATURES).collect()}
    assert len(one) == len(two) == 20
    assert all(np.allclose([r.intercept, *r.w], [two[r.fold_id, r.alpha].intercept, *two[r.fold_id, r.alpha].w], atol=1e-8) for r in one)
    a, b = (sorted(map(tuple, d.collect())) for d in (ridge.probe(df, "y", FEATURES, parted=True), ridge.probe(crossed, "y", FEATURES)))
    assert np.allclose(a, b) and a[0][2] == 90


def test_nulls_constants_and_single_rows(spark):
    df = made(spark, 20).withColumns({"a": F.when(F.col("id") % 3 != 0, F.col("a")), "b": F.lit(5.0), "c": F.when(F.col("id") == 4, float("nan")).otherwise(F.col("c")), "y": F.when(F.col("id") != 7, F.col("y")), "fold_id": F.lit(0), "role": F.lit("train")})
    r = ridge.coefficients(df, "y", FEATURES, (1.0,)).first()
    assert r.w[1] == 0.0 and all(np.isfinite(r.w))
    rows = np.array([(x.a or 0.0, 0.0 if x.id == 4 else x.c, x.y) for x in df.where("y is not null").collect()])
    x, y = rows[:, :2] - rows[:, :2].mean(0), rows[:, 2] - rows[:, 2].mean()
    assert np.allclose([r.w[0], r.w[2]], np.linalg.solve(x.T @ x + np.eye(2), x.T @ y))
    single = ridge.coefficients(df.where("id = 1"), "y", FEATURES, (1.0,)).first()
    assert single.w == [0.0, 0.0, 0.0] and abs(single.intercept - df.where("id = 1").first().y) < 1e-12
    assert ridge.coefficients(df.limit(0), "y", FEATURES).count() == 0 and ridge.terms(df.limit(0), "y", FEATURES, 1.0).count() == 0


def test_terms_are_the_largest_coefficients(spark):
    got = [tuple(r) for r in ridge.terms(made(spark), "y", FEATURES, 0.01, 2).collect()]
    assert [g[:2] for g in got] == [(1, "a"), (2, "b")] and got[0][2] > 1.5 and got[1][2] < -0.5
