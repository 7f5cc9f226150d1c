"""Cases that the star schema has none of: nulls, NaN, short groups, ties, zero denominators, leaks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.expr import entropy, hash_fold, log1p_floor, not_nan, ratio
from tessera.operators import assemble, audit, axis, encode, features, folds, metrics, model, profile, roles, shift, submit


def panel(spark, rows):
    return spark.createDataFrame(rows, "g string, t int, y double")


def collect(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(x) for x in r[: len(by) or 1]))


def test_short_groups_and_unknown_targets(spark):
    df = panel(spark, [("a", 1, 1.0), ("b", 1, 1.0), ("b", 2, 3.0), ("c", 1, 1.0), ("c", 2, None), ("c", 3, 5.0), ("c", 4, 7.0)])
    got = {(r.g, r.t): r for r in df.select("g", "t", *features.lags("y", ["g"], "t", [1]), *features.rolls("y", ["g"], "t", [4])).collect()}
    assert got["a", 1].lag_1 is None and got["a", 1].roll_mean_4 is None
    assert got["b", 2].roll_mean_4 == 1.0 and got["b", 2].roll_std_4 is None
    assert got["c", 4].roll_mean_4 == 3.0 and abs(got["c", 4].roll_std_4 - math.sqrt(8)) < 1e-12


def test_features_never_read_the_row_or_what_comes_after(spark):
    rng = random.Random(0)
    rows = [("a", i, rng.random()) for i in range(30)]
    build = lambda r: {x.t: tuple(x) for x in panel(spark, r).select("t", *features.lags("y", ["g"], "t", [1, 2]), *features.rolls("y", ["g"], "t", [4, 8])).collect()}
    changed = [(g, i, y if i < 20 else 99.0) for g, i, y in rows]
    a, b = build(rows), build(changed)
    assert all(a[i] == b[i] for i in range(21)) and a[25] != b[25]


def test_all_windows_share_one_exchange(spark):
    df = panel(spark, [("a", 1, 1.0)]).select("g", "t", *features.lags("y", ["g"], "t", [1, 2, 3, 4]), *features.rolls("y", ["g"], "t", [4, 8, 13]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_nan_is_null_for_aggregates(spark):
    df = panel(spark, [("a", 1, float("nan")), ("a", 2, 4.0)])
    assert df.agg(F.avg(not_nan("y"))).first()[0] == 4.0


def test_expressions(spark):
    df = spark.createDataFrame([(0.0, 0.0, -1.0), (1.0, 1.0, None)], "a double, b double, c double")
    r = df.select(entropy(["a", "b"]).alias("e"), log1p_floor("c").alias("l"), ratio("a", "b").alias("r")).collect()
    assert abs(r[0].e - math.log(2)) < 1e-6 and abs(r[1].e - math.log(2)) < 1e-6
    assert (r[0].l, r[1].l, r[0].r) == (0.0, None, 0.0)
    assert {x[0] for x in spark.range(200).select(hash_fold("id", 5)).collect()} == set(range(5))


def test_flags_are_no_ids_and_near_unique_floats_neither(spark):
    df = spark.createDataFrame([(i, i % 2, i * 1.5, 5 * i) for i in range(100)], "row long, flag int, x double, sparse long")
    got = {r["column"]: r.id_like for r in roles.id_like(df).collect()}
    assert got == {"row": True, "flag": False, "sparse": True}
    assert roles.find_id(df.drop("row")) == "sparse" and roles.find_id(df.select("flag", "x")) is None


def test_constant_and_all_null_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "c double, n double")
    state = encode.fit_scale(df, ["c", "n"])
    assert state.first().c_std == 1.0 and state.first().n_std == 1.0
    p = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert p["n"].null_pct == 100.0 and p["n"].mean is None and p["c"].n_unique == 1


def test_gate_at_fifty_values(spark):
    df = spark.createDataFrame([(str(i % 50), str(i % 51)) for i in range(200)], "a string, b string")
    assert {r["column"]: r.kept for r in roles.cardinality_gate(df).collect()} == {"a": True, "b": False}


def test_types_of_problems(spark):
    df = spark.createDataFrame([(i % 2, i % 5, i * 0.37, str(i % 3), i % 7 * 100) for i in range(300)], "two int, rating int, x double, text string, class_code int")
    kinds = {c: roles.subtype_of(df, c) for c in df.columns}
    assert kinds == {"two": "binary", "rating": "ordinal_regression", "x": "continuous_regression", "text": "multiclass", "class_code": "multiclass"}
    assert roles.classify(df, "two", None, []).kind == "tabular_classification" and roles.classify(df, "x", "t", []).kind == "time_series"
    assert roles.classify(df, "x", "t", ["g"]).kind == "panel_forecasting" and roles.classify(df, None, None, []).kind == "unknown"


def test_time_column(spark):
    df = spark.createDataFrame([(f"2024-01-{i % 28 + 1:02d}", i % 4, float(i)) for i in range(100)], "d string, store_id int, x double")
    assert roles.find_time(df) == "d"
    assert [r["column"] for r in roles.group_candidates(df, ("d",)).where("candidate").collect()] == ["store_id"]


def test_ks_with_ties_few_rows_and_equal_samples(spark):
    a = spark.createDataFrame([(float(i % 3), 1.0) for i in range(60)], "x double, k double")
    same = {r.feature: r for r in shift.ks(a, a, ["x", "k"]).collect()}
    assert same["x"].statistic == 0 and not same["k"].flagged
    assert shift.ks(a, a.limit(19), ["x"]).collect() == []
    moved = shift.ks(a, a.withColumn("x", F.col("x") + 10), ["x"]).first()
    assert moved.statistic == 1.0 and moved.flagged


def test_shift_without_spread_and_with_few_rows(spark):
    df = spark.createDataFrame([(1.0,)] * 6, "x double")
    assert shift.standardised_shift(df, df.withColumn("x", F.lit(2.0)), ["x"]).first()["shift"] == 0
    assert shift.standardised_shift(df, df.limit(4), ["x"]).first()["shift"] is None


def test_folds_that_do_not_fit(spark):
    assert folds.expanding(5, 5, 2, 1) == [folds.Span(0, 0, 2, 3, 5)]
    assert folds.expanding(3, 5, 6) == [] and len(folds.expanding(80, 5, 6, 1, 200)) == 5
    for spans in (folds.expanding(50, 5, 4, 2), folds.expanding(50, 5, 4, 2, 9), folds.purged(50, 4), folds.rolling_origin(50, 5, 4, 2)):
        assert spans and all(s.train_to <= s.valid_from and s.train_from < s.train_to for s in spans)
    a = folds.assign(spark.range(20).withColumnRenamed("id", "t"), "t", folds.expanding(20, 3, 3, 2))
    assert all(r.ordered for r in folds.invariants(a, "t", 2).collect())
    p = folds.plan("panel_forecasting", 60, 6, first_step=3)
    assert p["gap"] == 2 and p["frozen"] and folds.plan("panel_forecasting", 60, 6, first_step=3)["plan_id"] == p["plan_id"]


def test_group_folds_are_disjoint(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}") for i in range(30)], "k int, g string")
    out = folds.group_folds(df, "g", 5)
    assert folds.groups_disjoint(out, "g").isEmpty() and out.select("fold_id").distinct().count() == 3


def test_out_of_fold_encoding_ignores_the_own_fold(spark):
    rows = [("a", 0, 1.0), ("a", 1, 3.0), ("only", 0, 9.0), (None, 1, 2.0), (None, 0, 4.0)]
    df = spark.createDataFrame(rows, "c string, fold_id int, y double")
    mu = sum(r[2] for r in rows) / 5
    got = {(r.c, r.fold_id): r.c_te for r in encode.target_encode_oof(df, "c", "y").collect()}
    assert abs(got["a", 0] - (3 + 10 * mu) / 11) < 1e-12 and abs(got["only", 0] - mu) < 1e-12
    assert abs(got[None, 1] - (4 + 10 * mu) / 11) < 1e-12
    assert abs(encode.target_encode(df, spark.createDataFrame([("new",)], "c string"), "c", "y").first().c_te - mu) < 1e-12


def test_equal_group_means_and_few_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, y double")
    got = encode.relational_stats(df, "g", "y").collect()
    assert {r.group_rank for r in got} == {1} and all(r.gap_to_top == 0 and r.peer_mean == 1 for r in got)
    new = encode.relational_encode(df, spark.createDataFrame([("z",)], "g string"), "g", "y").first()
    assert (new.group_rank, new.peer_mean, new.gap_to_top) == (1.0, 1.0, 0.0)


def test_groups_that_end_early_have_their_own_last_value(spark):
    df = panel(spark, [("a", 1, 1.0), ("a", 5, None), ("b", 2, 7.0), ("b", 1, 3.0)])
    assert collect(assemble.last_known(df, ["g"], "t", "y")) == [("a", 1.0), ("b", 7.0)]


def test_tables_that_share_nothing_and_routing(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1,)], "y int")
    with pytest.raises(ValueError):
        assemble.left_fold([a, b])
    known, empty = spark.createDataFrame([(1, 2.0)], "k int, y double"), spark.createDataFrame([(1, None)], "k int, y double")
    got = assemble.route_files({"a.csv": known, "b.csv": empty, "val_x.csv": a, "test_known.csv": known, "submission.csv": b, "other.csv": a}, "y", {"other.csv": "val"})
    assert {k: v[0] for k, v in got.items()} == {"a.csv": "train", "b.csv": "submission", "val_x.csv": "val", "test_known.csv": "train", "submission.csv": "submission", "other.csv": "val"}


def test_periods_without_rank_are_an_error(spark):
    a, b = panel(spark, [("a", 1, 1.0)]), panel(spark, [("a", 9, 1.0)])
    with pytest.raises(ValueError, match="9"):
        axis.attach_rank(b, axis.period_rank(a, a, "t"), "t")


def test_cadence_at_a_bound():
    assert axis.granularity(1) == "hourly" and axis.granularity(24) == "daily" and axis.granularity(168) == "weekly" and axis.granularity(720) == "monthly"
    assert axis.granularity(50, irregular=True) == "agnostic" and axis.granularity(100, irregular=True) == "weekly"


def test_mode_of_gaps_takes_the_smallest(spark):
    r = axis.cadence(spark.createDataFrame([(1,), (2,), (1,), (2,), (9,)], "gap int")).first()
    assert r.modal_gap == 1 and r.irregular


def test_submission_keys(spark):
    template = spark.createDataFrame([(0, "a"), (1, "b")], "row_id int, k string").withColumn("y", F.lit(None).cast("double"))
    pred = spark.createDataFrame([("a", 1.0), ("x", 2.0)], "k string, p double")
    sub = submit.submission(template, pred, ["k"], "y", "p")
    audit_ = submit.round_trip(sub, pred, ["k"], "y", "p").first()
    assert (audit_.n_unmatched, audit_.n_different, audit_.passed) == (1, 0, False)
    off = sub.withColumn("y", F.col("y") + 2e-6)
    assert submit.round_trip(off, pred, ["k"], "y", "p").first().n_different == 1
    with pytest.raises(ValueError):
        submit.submission(template, pred.union(pred), ["k"], "y", "p")
    assert submit.check_output(sub, template, "y") == ["1 n_null"] and submit.check_output(submit.repair(sub, "y", 3.0), template, "y") == []


def test_verdicts():
    assert audit.too_good(0.005, 1.0) == "CV_INVALID" and audit.too_good(0.03, 1.0) == "CV_RISK" and audit.too_good(0.5, 1.0) == "CV_OK"
    assert audit.plausibility(0.01, 1.0, "FAIL") == "CRITICAL" and audit.plausibility(0.01, 1.0) == "PASS" and audit.plausibility(0.9, 1.0) == "WARNING"
    assert audit.concordance("CRITICAL", "CV_SCHEME") == "WARNING" and audit.concordance("CRITICAL", "REAL_DIVERGENCE") == "CRITICAL"
    assert audit.decide(["CRITICAL"], False, 1) == "retune" and audit.decide(["CRITICAL"], True, 2) == "accept" and audit.decide(["PASS"], False, 1) == "accept"
    assert audit.protected_families({"lags": [], "x": []}, {"problem": "time_series"}, 1) == {"lags"}
    assert [n for n, _ in shift.structural_leaks(["future_x", "y_sum", "y_lag_1", "price"], "y")] == ["future_x", "y_sum"]


def test_collapse_and_negatives(spark):
    p = spark.createDataFrame([(1.0, 1), (-2.0, 1)], "p double, label int")
    assert audit.collapse(p, "label").first().verdict == "CRITICAL"
    train = spark.createDataFrame([(0.0,), (5.0,)], "y double")
    assert audit.sanity(p, train, "y", "p").first().verdict == "CRITICAL"


def test_ridge_equals_its_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x, alpha = rng.normal(size=(80, 2)), 3.0
    y = x @ [2.0, -1.0] + 4 + rng.normal(size=80)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, y double")
    w = model.ridge(df, "y", ["a", "b"], alpha).stages[-1].coefficients.toArray()
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(w, np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc), atol=1e-6)


def test_recursion_feeds_predictions_back(spark):
    rows = [(g, t, float(t % 4)) for g in "ab" for t in range(24)]
    df = panel(spark, rows)
    got = model.recursive_forecast(df.where("t < 20"), df.where("t >= 20"), ["g"], "t", "y", [1, 2, 3, 4], 10).collect()
    assert len(got) == 8 and all(abs(r.prediction - r.t % 4) < 0.5 for r in got)


def test_auc_and_weights(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first().auc == 0.625
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first().auc is None
    assert [r.weight for r in metrics.class_weights(df, "y").collect()] == [1.0, 1.0]
    assert {r.weight for r in shift.weights_from_scores(df, "s", 0.5).collect()} == {1.0}


def test_text_to_codebook(spark):
    book = {f"id{i}": f"2024-{i:02d}-01" for i in range(1, 13)}
    assert axis.codebook(spark, book).where("date is not null").count() == 12
    assert axis.codebook(spark, {v: k for k, v in book.items()}).where("date is not null").count() == 12
    with pytest.raises(ValueError):
        axis.codebook(spark, {"a": "2024-01-01"})
