import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tessera.operators import fold_fit, folds, model

SCHEMA = "id long, g string, h string, x double, y double"
STEPS = [
    {"name": "scale_features", "targets": ["x"]},
    {"name": "impute_missing", "targets": ["x"], "strategy": "mean"},
    {"name": "group_relational", "targets": ["h"], "min_cardinality": 3, "skew_threshold": -9.0},
    {"name": "target_encode", "targets": ["g"], "smoothing": 2.0},
]


def rows():
    out = [(i, "abc"[i % 3], f"h{i * i % 7}", None if i % 6 == 0 else float(i % 11), float((i * 7) % 13)) for i in range(60)]
    return out + [(60, None, None, 1.0, 5.0), (61, "rare", "alone", 2.0, None)]


def assigned(spark, extra=()):
    df = spark.createDataFrame([*rows(), *extra], SCHEMA)
    return folds.crossed(folds.kfold(df, "id", 3), 3)


def inner(spark):
    """id -> inner fold, by the same expression."""
    stage = fold_fit.FoldTargetEncoder(columns=["g"], target="y", key=["id"])
    return {r.id: r.f for r in spark.createDataFrame(rows(), SCHEMA).select("id", stage.inner_fold().alias("f")).collect()}


def test_every_stage_equals_plain_loops(spark):
    df = assigned(spark)
    built = fold_fit.build(STEPS, "y", ["id"], "linear")
    assert built.encoded == ["h_rank", "h_peer_mean", "h_gap_to_top", "g_te"]
    got = {(r.id, r.fold_id): r for r in fold_fit.fitted(df, built.stages).collect()}
    held, of = inner(spark), {}
    for r in df.collect():
        of.setdefault(r.fold_id, {})[r.id] = r
    assert len(got) == 62 * 3
    for f, every in of.items():
        train = {i: r for i, r in every.items() if r.role == "train"}
        known = [r.x for r in train.values() if r.x is not None]
        fill = sum(known) / len(known)
        ys = [r.y for r in train.values() if r.y is not None]
        mu = sum(ys) / len(ys)
        te = {}
        for i, r in every.items():
            own = [o.y for j, o in train.items() if o.g == r.g and o.y is not None and (r.role == "valid" or held[j] != held[i])]
            te[i] = (sum(own) + 2 * mu) / (len(own) + 2)
        x = {i: fill if r.x is None else r.x for i, r in every.items()}

        def scaled(values, i, train=train):
            own = [values[j] for j in train]
            m = sum(own) / len(own)
            return (values[i] - m) / math.sqrt(sum((v - m) ** 2 for v in own) / (len(own) - 1))

        for i, r in every.items():
            assert math.isclose(got[i, f].x, scaled(x, i), abs_tol=1e-9)
            assert math.isclose(got[i, f].g_te, scaled(te, i), abs_tol=1e-9)
            groups = {}
            for j, o in train.items():
                if o.y is not None and (r.role == "valid" or held[j] != held[i]):
                    groups.setdefault(o.h or "__NA__", []).append(o.y)
            means = {h: sum(v) / len(v) for h, v in groups.items()}
            dense = {m: k + 1 for k, m in enumerate(sorted({round(m, 9) for m in means.values()}, reverse=True))}
            ranks = {h: dense[round(m, 9)] for h, m in means.items()}
            h = r.h or "__NA__"
            if h in means:
                want = ranks[h], (sum(means.values()) - means[h]) / (len(means) - 1), means[h] - sum(sorted(means.values())[-3:]) / 3
            else:
                want = sum(ranks.values()) / len(ranks), mu, 0.0
            assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip((got[i, f].h_rank, got[i, f].h_peer_mean, got[i, f].h_gap_to_top), want, strict=True))


def test_validation_rows_are_in_no_state(spark):
    """Other values in a fold's validation rows change neither its states nor what its training rows become."""
    df = assigned(spark)
    odd = df.withColumns({c: F.when(F.col("role") == "valid", F.col(c) * 100 + 7).otherwise(F.col(c)) for c in ("x", "y")})
    stages = fold_fit.build(STEPS, "y", ["id"], "linear").stages
    plain, changed = (Pipeline(stages=stages).fit(d) for d in (df, odd))
    for a, b in zip(plain.stages, changed.stages, strict=True):
        assert sorted(map(str, a.state.collect())) == sorted(map(str, b.state.collect()))
    train = lambda p, d: sorted(map(str, p.transform(d).where("role = 'train'").collect()))
    assert train(plain, df) == train(changed, odd)


def test_fitted_stages_are_saved_and_read(spark, tmp_path):
    df = assigned(spark)
    stages = fold_fit.build(STEPS, "y", ["id"], "linear").stages
    fitted = Pipeline(stages=stages).fit(df)
    fitted.write().save(f"{tmp_path}/fitted")
    again = PipelineModel.load(f"{tmp_path}/fitted")
    assert [type(s) for s in again.stages] == [type(s) for s in fitted.stages]
    assert sorted(map(str, again.transform(df).collect())) == sorted(map(str, fitted.transform(df).collect()))
    Pipeline(stages=stages).write().save(f"{tmp_path}/stages")
    assert [s.uid for s in Pipeline.load(f"{tmp_path}/stages").getStages()] == [s.uid for s in stages]


def test_columns_that_do_not_qualify_and_unseen_categories(spark):
    df = assigned(spark)
    none = fold_fit.fitted(df, [fold_fit.FoldRelationalEncoder(columns=["g"], target="y", key=["id"])])
    assert none.where("g_rank is not null or g_peer_mean is not null").isEmpty()
    te = fold_fit.fitted(df, [fold_fit.FoldTargetEncoder(columns=["h"], target="y", key=["id"])])
    assert te.where("h_te is null").isEmpty() and te.count() == df.count()


def test_medians_by_fold_and_folds_without_values(spark):
    df = spark.createDataFrame([(0, "train", None), (0, "valid", 4.0), (1, "train", 1.0), (1, "train", 4.0), (1, "train", None), (1, "valid", None), (2, "valid", None)], "fold_id int, role string, x double")
    got = sorted(map(tuple, fold_fit.fitted(df, [fold_fit.FoldImputer(columns=["x"])]).collect()), key=str)
    assert got == sorted([(0, "train", None), (0, "valid", 4.0), (1, "train", 1.0), (1, "train", 4.0), (1, "train", 2.5), (1, "valid", 2.5), (2, "valid", None)], key=str)
    empty = df.limit(0)
    assert fold_fit.fitted(empty, [fold_fit.FoldImputer(columns=["x"]), fold_fit.FoldScaler(columns=["x"])]).count() == 0


def test_factory_by_model(spark):
    boosted = fold_fit.build(STEPS, "y", ["id"])
    assert [type(s).__name__ for s in boosted.stages] == ["FoldImputer", "FoldRelationalEncoder"] and boosted.categorical == ["g"]
    linear = fold_fit.build(STEPS, "y", ["id"], "linear")
    assert [type(s).__name__ for s in linear.stages] == ["FoldImputer", "FoldRelationalEncoder", "FoldTargetEncoder", "FoldScaler"]
    assert linear.stages[-1].of("columns") == ["x", "g_te"]
    for bad in ([{"name": "other"}], ):
        with pytest.raises(ValueError):
            fold_fit.build(bad, "y", ["id"])
    with pytest.raises(ValueError):
        fold_fit.build([], "y", ["id"], "deep")
    with pytest.raises(ValueError):
        fold_fit.FoldImputer(columns=["x"], how="mode")


def test_out_of_fold_predictions_behind_stages(spark):
    df = assigned(spark).where("y is not null")
    built = fold_fit.build(STEPS[:3], "y", ["id"])
    oof = model.cv_oof(df, ["id"], "y", ["x", "g", *built.encoded], stages=built.stages, categorical=["g"], rounds=2)
    assert oof.count() == 61 and oof.where("prediction is null").isEmpty()
