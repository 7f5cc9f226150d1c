import time

import pytest

from tessera.operators import folds, model, tuning


@pytest.fixture(scope="module")
def assigned(spark):
    rows = [(g, t, float((t * 5 + ord(g)) % 7), float(t % 7), float(ord(g))) for g in "abc" for t in range(30)]
    df = spark.createDataFrame(rows, "g string, t int, y double, a double, b double")
    return folds.assign(df, "t", folds.expanding(30, 2, 5, 1))


def errors(space):
    """A stand-in for the fits: deeper is better, the more so with more rounds; later settings finish first."""

    def fake(parts, target, features, seed, scored=None, *, rate, depth, rounds):
        time.sleep(0.2 * rate)
        return 10 - depth - rounds / 100 + rate

    return fake


def test_halving_keeps_the_better_half_and_not_the_first_to_end(assigned, monkeypatch):
    monkeypatch.setattr(tuning, "cv_error", errors(None))
    found = [tuning.search(assigned, "y", ["a"], trials=7, rounds=40, rungs=3, seed=5, workers=w) for w in (1, 4, 7)]
    assert found[0] == found[1] == found[2]
    by = [{n for r, n, *_ in found[0].trials if r == rung} for rung in range(3)]
    assert [len(b) for b in by] == [7, 4, 2] and by[0] > by[1] > by[2]
    assert [{t[4] for t in found[0].trials if t[0] == r} for r in range(3)] == [{10}, {20}, {40}]
    first = sorted((t[5], t[1]) for t in found[0].trials if t[0] == 0)
    assert by[1] == {n for _, n in first[:4]}
    last = min((t for t in found[0].trials if t[0] == 2), key=lambda t: (t[5], t[1]))
    assert found[0].settings == {"rate": last[2], "depth": last[3], "rounds": 40} and found[0].mae == last[5] and found[0].in_time


def test_settings_lie_within_the_bounds_and_wide_ones_reach_further():
    import random

    rng = random.Random(1)
    plain, wide = tuning.Space(), tuning.Space().wide()
    for space in (plain, wide):
        drawn = [space.draw(rng) for _ in range(300)]
        assert all(space.rate[0] <= d["rate"] <= space.rate[1] and space.depth[0] <= d["depth"] <= space.depth[1] for d in drawn)
        assert {d["depth"] for d in drawn} == set(range(space.depth[0], space.depth[1] + 1))
    assert wide == tuning.Space((0.005, 0.15), (4, 10)) and tuning.Space((0.001, 0.02), (2, 3)).wide() == tuning.Space((0.001, 0.15), (2, 10))


def test_real_fits_and_scored_rows(assigned):
    from pyspark.sql import functions as F

    found = tuning.search(assigned, "y", ["a", "b"], trials=2, rounds=2, rungs=2, workers=2)
    assert len(found.trials) == 3 and found.in_time and found.table(assigned.sparkSession).count() == 3
    again = tuning.search(assigned, "y", ["a", "b"], trials=2, rounds=2, rungs=2, workers=1)
    assert again.settings == found.settings and abs(again.mae - found.mae) < 1e-9
    part = [tuple(assigned.where(f"fold_id = 0 and role = '{r}'") for r in ("train", "valid"))]
    one = tuning.cv_error(part, "y", ["a", "b"], 42, F.col("g") == "a", rounds=2)
    pred = model.fit_predict(*part[0], ["a", "b"], model.gbt("y", 42, rounds=2)).where("g = 'a'").collect()
    assert abs(one - sum(abs(r.y - r.prediction) for r in pred) / len(pred)) < 1e-9
    assert tuning.cv_error(part, "y", ["a", "b"], 42, F.lit(False), rounds=2) == tuning.cv_error(part, "y", ["a", "b"], 42, rounds=2)


def test_a_deadline_cancels_what_runs_and_keeps_the_last_finished_rung(assigned, monkeypatch):
    spark = assigned.sparkSession

    def slow(parts, target, features, seed, scored=None, *, rate, depth, rounds):
        if rounds > 10:  # a job that only its cancellation ends
            spark.range(0, 8, 1, 8).selectExpr("java_method('java.lang.Thread', 'sleep', 60000L)").collect()
        return float(depth)

    monkeypatch.setattr(tuning, "cv_error", slow)
    began = time.monotonic()
    found = tuning.search(assigned, "y", ["a"], trials=4, rounds=20, rungs=2, seconds=3.0, workers=2)
    assert time.monotonic() - began < 40 and not found.in_time
    assert {t[0] for t in found.trials} == {0} and found.mae == min(t[5] for t in found.trials) and found.settings["rounds"] == 20


def test_search_by_fold_takes_medians(assigned, monkeypatch):
    monkeypatch.setattr(tuning, "cv_error", errors(None))
    inner = {f: folds.assign(assigned.where(f"fold_id = {f} and role = 'train'").drop("fold_id", "role"), "t", folds.expanding(18, 2, 4, 1)) for f in (0, 1)}
    each = [tuning.search(inner[f], "y", ["a"], trials=3).settings for f in (0, 1)]
    assert tuning.search_by_fold(assigned, "y", ["a"], inner, trials=3) == tuning.settled(each)
    assert tuning.settled([{"rate": 0.1, "depth": 3}, {"rate": 0.3, "depth": 8}, {"rate": 0.2, "depth": 4}]) == {"rate": 0.2, "depth": 4}
    assert tuning.settled([{"rate": 0.1, "depth": 3}, {"rate": 0.3, "depth": 6}]) == {"rate": 0.2, "depth": 4} and tuning.settled([]) == {}


def test_a_second_cycle_acts(assigned):
    cycle = tuning.Cycle(("a", "b"))
    assert tuning.retuned(cycle, set(), []) == cycle
    assert tuning.retuned(cycle, {"CV_RISK"}, ["b", "other"]) == tuning.Cycle(("a",), tuning.Space(), "median")
    assert tuning.retuned(cycle, {"CV_INVALID"}, ["a", "b"]) == tuning.Cycle(("a", "b"), tuning.Space().wide(), "mean")
    again = tuning.retuned(cycle, {"CV_RISK", "CV_INVALID"}, ["b"])
    oof, found = tuning.run_cycle(assigned, ["g", "t"], "y", again, (1, 2, 3), trials=1, rounds=2, rungs=1)
    rows = oof.collect()
    assert len(rows) == 30 and 4 <= found.settings["depth"] <= 10 and {"prediction", "disagreement"} <= set(oof.columns)
    seeds = model.cv_oof(assigned, ["g", "t"], "y", ["a"], (1, 2, 3), **found.settings).where("g = 'a' and t = 29").collect()
    want = sorted(r.prediction for r in seeds)[1]
    assert abs(next(r for r in rows if r.g == "a" and r.t == 29).prediction - want) < 1e-9


def test_early_rounds(spark):
    rows = [(float(i), float(i > 20), i % 4 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, y double, held boolean")
    assert 1 <= model.early_rounds(df, "y", ["x"], "held", 6) <= 6


def test_importance_names_the_right_feature(spark):
    rows = [("ab"[i % 2], float(i % 5), 10.0 * (i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "c string, x double, y double")
    found = model.shares(df, ["c", "x"], model.gbt("y", rounds=3), ["c"])
    assert found["c"] > 0.99 and found["x"] < 0.01
    assert abs(sum(found.values()) - 1) < 1e-9
