import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import adversarial, metrics, model


def tables(spark, n=420, m=180, seed=1, shift=2.0):
    rng = random.Random(seed)
    row = lambda i, moved: (i, rng.gauss(shift if moved else 0.0, 1.0), rng.random(), None if i % 9 == 0 else rng.random(), f"t{i}")
    schema = "id long, moved double, still double, holes double, text string"
    return spark.createDataFrame([row(i, False) for i in range(n)], schema), spark.createDataFrame([row(1000 + i, True) for i in range(m)], schema)


def test_a_shift_is_found_weighed_and_named(spark):
    train, val = tables(spark)
    found = adversarial.validate(train, val, "id", rounds=3, k=3)
    s = found.summary.first()
    assert (s.n_train, s.n_val, s.n_columns, s.skip_reason, s.applied) == (420, 180, 3, None, True) and s.auc > 0.8
    w = found.weights.join(train, "id").collect()
    assert len(w) == 420 and abs(sum(r.weight for r in w) / 420 - 1) < 1e-9
    near, far = ([r.weight for r in w if (r.moved > 1.5) == side] for side in (True, False))
    assert sum(near) / len(near) > 1.5 * sum(far) / len(far)  # rows that look like those to predict count more
    top = found.top.collect()
    assert top[0].column == "moved" and top[0].fall > 0.2 and all(abs(t.fall) < 0.1 for t in top[1:]) and len(top) == 3
    weighted = train.join(found.weights, "id").withColumn("y", F.col("moved") * 2)
    assert model.fit_predict(weighted, weighted, ["still", "moved"], model.gbt("y", rounds=2, weight="weight")).count() == 420


def test_scores_are_out_of_fold_and_folds_hold_either_side_alike(spark):
    train, val = tables(spark)
    both, names = adversarial.sides(train, val, "id")
    assert names == ["moved", "still", "holes"] and both.where("holes is null").isEmpty()
    fit = adversarial.cross_fit(both, "id", names, k=3, rounds=2)
    n = {(r.fold_id, r.is_train): r["count"] for r in fit.rows.groupBy("fold_id", "is_train").count().collect()}
    assert set(n.values()) == {140, 60}
    assert fit.scores().count() == 600 and fit.scores().select("id").distinct().count() == 600


def test_without_a_shift_all_weights_are_one(spark):
    train, val = tables(spark, shift=0.0)
    found = adversarial.validate(train, val, "id", rounds=2, k=3)
    assert found.summary.first().skip_reason == "no shift" and {r.weight for r in found.weights.collect()} == {1.0}


@pytest.mark.parametrize(("n", "m", "columns", "why"), [(200, 200, None, "few rows"), (50, 500, None, "few training rows"), (500, 50, None, "few rows to predict"), (420, 180, ["moved", "text"], "few columns")])
def test_gates(spark, n, m, columns, why):
    train, val = tables(spark, n, m)
    found = adversarial.validate(train, val, "id", columns)
    s = found.summary.first()
    assert s.skip_reason == why and not s.applied and s.auc is None
    assert found.weights.count() == n and {r.weight for r in found.weights.collect()} == {1.0} and found.top.isEmpty()


def test_no_rows(spark):
    train, val = (t.limit(0) for t in tables(spark, 5, 5))
    assert adversarial.validate(train, val, "id").summary.first().skip_reason == "few rows"


def test_auc_of_groups_equals_each_alone(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.8), ("a", 0, 0.1), ("b", 1, 0.2), ("b", 0, 0.4)], "g string, y int, s double")
    assert {r.g: r.auc for r in metrics.roc_auc(df, "y", "s", ["g"]).collect()} == {"a": 0.625, "b": 0.0}


def coarse(spark, n=12000):
    """Rows of three columns with 5, 4 and 3 values."""
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(5)), float(rng.randrange(4)) / 8, float(rng.choice([1, 10, 100]))) for i in range(n)]
    both = spark.createDataFrame(rows, "id long, a double, b double, c double")
    return both.withColumn("is_train", ((F.col("a") + F.col("b") * F.col("c") / 20 + F.pmod(F.hash("id"), F.lit(9))) < 6).cast("int"))


class Counted(GBTClassifier):
    seen: list = []

    def _fit(self, dataset):
        self.seen.append(dataset.count())
        return super()._fit(dataset)


def test_a_fit_reads_no_more_rows_than_there_are_cells_and_equals_that_of_rows(spark, monkeypatch):
    monkeypatch.setattr(adversarial, "GBTClassifier", Counted)
    Counted.seen.clear()
    fit = adversarial.cross_fit(coarse(spark), "id", ["a", "b", "c"], k=2, rounds=3, depth=4)
    assert len(Counted.seen) == 2 and max(Counted.seen) <= 5 * 4 * 3 * 2 < 6000
    got = {r.id: r.score for r in fit.scores().collect()}
    assert len(got) == 12000
    for f in range(2):
        whole = Pipeline(stages=[*model.assembler(fit.rows, fit.columns), GBTClassifier(labelCol="is_train", maxIter=3, maxDepth=4, stepSize=0.05, seed=42)]).fit(fit.rows.where(F.col("fold_id") != f))
        for r in whole.transform(fit.rows.where(F.col("fold_id") == f)).select("id", vector_to_array("probability")[1].alias("score")).collect():
            assert abs(got[r.id] - r.score) < 1e-9


def test_scores_do_not_depend_on_how_the_rows_are_dealt(spark):
    rng = random.Random(5)
    both = spark.createDataFrame([(i, rng.random() + i % 3 * 0.1, rng.gauss(0.0, 1.0), 1 if i % 3 else 0) for i in range(24000)], "id long, x double, y double, is_train int")
    scores = []
    try:
        for n in (2, 9):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", n)
            scores.append({r.id: r.score for r in adversarial.cross_fit(both, "id", ["x", "y"], k=2, rounds=2, depth=3).scores().select("id", "score").collect()})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(scores[0]) == 24000 and all(abs(scores[0][i] - scores[1][i]) < 1e-9 for i in scores[0])


def test_cuts(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i % 2, float(i), 0.0 if i < 700 else float(i), float(i % 3), 7.0, None if i % 5 else nan, [-inf, 1.0, 2.0, inf][i // 2 % 4]) for i in range(1000)]
    got = adversarial.cuts(spark.createDataFrame(rows, "fold_id int, many double, heavy double, few double, one double, none double, ends double"), ["many", "heavy", "few", "one", "none", "ends"], 2, 10)
    odd = [x for x in range(1000) if x % 2]  # the rows of fold 1, from which fold 0 learns
    assert got[0][0] == [(odd[i * 50 - 1] + odd[i * 50]) / 2 for i in range(1, 10)]
    assert got[0][1][0] == 701 / 2 and len(got[0][1]) == 3 and got[0][2] == [0.5, 1.5] and got[0][3:5] == [[], []] and got[0][5] == [1.0, 1.5]  # no bound parts infinity from the rest
    assert got[1][0] == [x - 1 for x in got[0][0]]


def test_columns_without_numbers_in_a_side_or_with_one_value(spark):
    train, val = tables(spark)
    odd = lambda t, unknown: t.withColumns({"one": F.lit(3.0), "gone": F.lit(None).cast("double") if unknown else F.col("still"), "nans": F.when(F.col("id") % 4 == 0, float("nan")).otherwise(F.col("still")), "ends": F.when(F.col("id") % 4 == 0, float("inf")).otherwise(F.col("still"))})
    found = adversarial.validate(odd(train, True), odd(val, False), "id", rounds=2, k=2)
    s = found.summary.first()
    assert s.n_columns == 7 and s.auc > 0.8 and found.weights.count() == 420
