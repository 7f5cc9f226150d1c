import random
import statistics

import numpy as np
import pytest

from tessera.operators.encode import fit_fill
from tessera.operators.profile import column_profile
from tessera.operators.running import exact_medians, exact_percentiles, running_sums


@pytest.mark.parametrize("slices", [2, 16])
def test_running_sums_equal_plain_ones(spark, slices):
    rng = random.Random(slices)
    rows = [(k, v, rng.randint(0, 5), rng.randint(0, 5)) for k in "ab" for v in sorted({rng.gauss(0, 3) for _ in range(120)})]
    got = {(r.k, r.v): r for r in running_sums(spark.createDataFrame(rows, "k string, v double, x long, y long"), "v", ["x", "y"], ["k"], slices).collect()}
    assert len(got) == len(rows)
    for k in "ab":
        x = y = 0
        own = [r for r in rows if r[0] == k]
        for _, v, a, b in own:
            x, y = x + a, y + b
            assert (got[k, v].cum_x, got[k, v].cum_y, got[k, v].all_x) == (x, y, sum(r[2] for r in own))


def test_percentiles_with_ties_single_values_and_none(spark):
    values = [float(random.Random(1).randint(0, 9)) for _ in range(1)] + [float(i % 7) for i in range(101)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    at = {f"p{p}": p / 100 for p in (0, 1, 25, 50, 99, 100)}
    got = exact_percentiles(df, "v", at).first()
    assert all(abs(got[n] - np.percentile(values, 100 * p)) < 1e-12 for n, p in at.items())
    assert exact_percentiles(df.limit(0), "v", {"p50": 0.5}).first()["p50"] is None
    assert exact_percentiles(df.where("v = 3").limit(1), "v", {"p50": 0.5}).first()["p50"] == 3.0


def test_medians_of_several_columns(spark):
    rows = [(i % 7, float(i) ** 1.5 if i % 3 else None, None, "x") for i in range(200)] + [(None, 2.5, None, None)]
    df = spark.createDataFrame(rows, "column int, b double, none double, name string")
    got = {r["column"]: r["median"] for r in exact_medians(df, ["column", "b", "none"]).collect()}
    for i, c in enumerate(("column", "b")):
        assert got[c] == pytest.approx(statistics.median(r[i] for r in rows if r[i] is not None))
    assert "none" not in got
    fill = fit_fill(df, ["column", "b", "none"]).first()
    assert (fill["column"], fill["none"]) == (got["column"], None)
    assert {r["column"]: r["median"] for r in column_profile(df).collect()} == {**got, "none": None, "name": None}
    assert fit_fill(df.limit(0), ["b"]).first()["b"] is None
    assert column_profile(df.select("name")).first()["median"] is None


def test_rows_of_a_feature_are_not_dealt_by_the_feature(spark):
    """Joins with bounds and totals are broadcast: a sort-merge join by feature would bring all values of a column to one task."""
    from tessera.operators import shift

    rows = [(float(i % 700), float(i % 31)) for i in range(2000)]
    a, b = spark.createDataFrame(rows, "u double, v double"), spark.createDataFrame([(u + 5, v) for u, v in rows], "u double, v double")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = shift.ks(a, b, ["u", "v"])
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r.feature: round(r.statistic, 4) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    side = lambda s, at: sum(u <= at for u, _ in s) / len(s)
    moved = [(u + 5, v) for u, v in rows]
    assert got == {"u": round(max(abs(side(rows, x) - side(moved, x)) for x in range(710)), 4), "v": 0.0}
