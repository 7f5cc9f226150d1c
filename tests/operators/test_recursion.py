import math
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import model, recursion

LAGS, WINDOWS = [1, 3], [2, 4]
NAMES = recursion.feature_names(LAGS, WINDOWS)


def panel(spark, rows):
    return spark.createDataFrame(rows, "g string, t int, y double, z double")


def rule(rows):
    """A prediction that reads every feature."""
    return rows.withColumn("prediction", sum((F.col(n) * (i + 1) / 8 for i, n in enumerate(NAMES)), F.lit(0.5)) + F.coalesce("z", F.lit(0.0)))


def plain(history, steps, top):
    """The same by lists: {step: prediction} of one group."""
    h, out = list(history), {}
    for step, z in steps:
        f = [h[-k] if len(h) >= k else (h[-1] if h else 0.0) for k in LAGS]
        for w in WINDOWS:
            part = h[-w:]
            f += [sum(part) / len(part) if part else 0.0, statistics.stdev(part) if len(part) > 1 else 0.0]
        p = min(max(sum(x * (i + 1) / 8 for i, x in enumerate(f)) + 0.5 + z, 0.0), top)
        out[step] = p
        h.append(p)
    return out


def test_recursion_equals_lists(spark):
    train = [(g, t, float((t * 7 + ord(g)) % 5) if t % 4 or g != "b" else None, 0.0) for g in "ab" for t in range(9)] + [("c", 8, 2.0, 0.0)]
    val = [(g, t, None, 0.25 * (t - 9)) for g in "abcd" for t in range(9, 15) if (g, t) not in (("b", 10), ("c", 9))]
    got = recursion.forecast(panel(spark, train), panel(spark, val), ["g"], "t", "y", LAGS, WINDOWS, rule, ("z",)).collect()
    assert len(got) == len(val)
    top = 10 * max(y for *_, y, _ in train if y is not None)
    for g in "abcd":
        history = [y for h, _, y, _ in train if h == g and y is not None]
        want = plain(history, [(t, z) for h, t, _, z in val if h == g], top)
        last = history[-1] if history else 0.0
        for r in (r for r in got if r.g == g):
            assert r.step == r.t - 8 and math.isclose(r.recursive, want[r.t], abs_tol=1e-9)
            flat = sum((0.0 if n.startswith("roll_std") else last) * (i + 1) / 8 for i, n in enumerate(NAMES)) + 0.5 + 0.25 * (r.t - 9)
            assert math.isclose(r.imputed, min(max(flat, 0.0), top), abs_tol=1e-9)


def test_plans_do_not_grow_with_the_horizon(spark):
    train = panel(spark, [("a", t, float(t % 3), 0.0) for t in range(9)])
    sizes = []
    for horizon in (4, 20):
        out = recursion.forecast(train, panel(spark, [("a", 9 + t, None, 0.0) for t in range(horizon)]), ["g"], "t", "y", LAGS, WINDOWS, rule, ("z",))
        assert out.count() == horizon
        sizes.append(len(out._jdf.queryExecution().logical().toString()))
    assert abs(sizes[0] - sizes[1]) < 50


def test_the_better_way_of_each_step_is_taken(spark):
    rows = [("a", t, float(t), 0.0) for t in range(12)]
    up = lambda known: lambda rows: rows.withColumn("prediction", F.col("lag_1") + 1)
    out, choices = recursion.chosen(panel(spark, rows), panel(spark, [("a", t, None, 0.0) for t in (12, 13, 14)]), ["g"], "t", "y", [1], [], up)
    got = {r.step: r for r in out.collect()}
    assert [got[s].prediction for s in (1, 2, 3)] == [12.0, 13.0, 14.0] and {r.choice for r in got.values()} == {"recursive"}
    assert {r.step: (r.recursive_mae, r.last_known_mae) for r in choices.collect()} == {1: (0.0, 0.0), 2: (0.0, 1.0), 3: (0.0, 2.0), None: (0.0, 1.0)}
    drifts = lambda known: lambda rows: rows.withColumn("prediction", F.col("lag_1") * 1.5)
    flat = panel(spark, [("a", t, 4.0, 0.0) for t in range(12)])
    out, _ = recursion.chosen(flat, panel(spark, [("a", t, None, 0.0) for t in (12, 13)]), ["g"], "t", "y", [1], [], drifts)
    assert {r.step: (r.choice, r.prediction) for r in out.collect()} == {1: ("recursive", 6.0), 2: ("last_known", 6.0)}


def test_scored_rows_decide(spark):
    rows = [(g, t, float(t) if g == "a" else 4.0, 0.0) for g in "ab" for t in range(10)]
    up = lambda known: lambda rows: rows.withColumn("prediction", F.col("lag_1") + 1)
    val = panel(spark, [(g, t, None, 0.0) for g in "ab" for t in (10, 11)])
    for g, want in (("a", "recursive"), ("b", "last_known")):
        out, _ = recursion.chosen(panel(spark, rows), val, ["g"], "t", "y", [1], [], up, scored=F.col("g") == g)
        assert {r.choice for r in out.where("step = 2").collect()} == {want}


def test_repeated_rows_and_no_rows(spark):
    train = panel(spark, [("a", t, 1.0, 0.0) for t in range(5)])
    with pytest.raises(ValueError, match="share"):
        recursion.forecast(train, panel(spark, [("a", 5, None, 0.0)] * 2), ["g"], "t", "y", LAGS, WINDOWS, rule, ("z",))
    assert recursion.forecast(train, train.limit(0), ["g"], "t", "y", LAGS, WINDOWS, rule, ("z",)).count() == 0


def test_trees_follow_a_cycle(spark):
    rows = [(g, t, float(t % 4), 0.0) for g in "ab" for t in range(40)]
    df = panel(spark, rows)
    got = model.recursive_forecast(df.where("t < 34"), df.where("t >= 34"), ["g"], "t", "y", [1, 2, 3, 4], 10).collect()
    assert len(got) == 12 and all(abs(r.prediction - r.t % 4) < 0.5 for r in got)
