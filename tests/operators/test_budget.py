from pyspark.sql import functions as F

from tessera.operators import budget

ONE = {"a": ["a1"]}  # columns are only counted here


def wide(**n):
    return {f: [f"{f}{i}" for i in range(k)] for f, k in n.items()}


def test_families_are_admitted_by_gain_a_column_until_the_budget_is_used_up():
    found = budget.admit(budget.Size(10, 80), ONE, wide(x=4, y=2, z=3), {"x": 0.9, "y": 0.8, "z": 0.1}, budget.Budget(columns=6))
    assert list(found.admitted) == ["a", "x", "y"] and found.refused == {"z": "9 added columns > 6"} and len(found.columns) == 7
    # a family that doesn't fit leaves room for a later one that does
    found = budget.admit(budget.Size(10, 80), {}, wide(x=5, y=2), {"x": 9.0, "y": 0.1}, budget.Budget(columns=4))
    assert list(found.admitted) == ["y"] and list(found.refused) == ["x"]


def test_cells_and_memory_refuse_too():
    size = budget.Size(1_000_000, 1 << 30)
    found = budget.admit(size, ONE, wide(x=2, y=1), None, budget.Budget(cells=1.5e6))
    assert list(found.admitted) == ["a", "y"] and found.refused["x"].startswith("3000000 added cells")
    found = budget.admit(size, ONE, wide(x=2, y=1), None, budget.Budget(memory=9_000_000))
    assert list(found.admitted) == ["a", "y"] and "added bytes > 9000000" in found.refused["x"]
    everything = budget.admit(size, ONE, wide(x=2, y=1))
    assert list(everything.admitted) == ["a", "x", "y"] and not everything.refused


def test_estimates_come_from_the_plan_and_run_nothing(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    size = budget.estimate(df)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before
    assert size.bytes > 0 and 1_000 < size.rows < 10_000_000
    assert budget.estimate(spark.range(1234)).rows == 1234
    assert budget.executor_memory(df) > 1 << 20


def test_panel_features_call_the_gate(spark):
    rows = [(g, t, float(t % 5), float(t), 2.0 + t % 3) for g in "ab" for t in range(12)]
    df = spark.createDataFrame(rows, "g string, t int, y double, u double, v double")
    every, found = budget.panel_features(df, ["g"], "t", "y")
    assert list(found.admitted) == ["lags", "rolls", "cov_lags", "cov_rolls_ext", "cov_ratios", "cov_group_stats", "cov_entropy"] and not found.refused
    assert every.count() == 24 and {"u_roll8", "v_std4", "u_per_v", "v_group_dev", "cov_entropy"} <= set(every.columns)
    few, found = budget.panel_features(df, ["g"], "t", "y", budget=budget.Budget(columns=4), gain={"cov_ratios": 5.0, "cov_group_stats": 0.1})
    assert set(found.refused) == {"cov_rolls_ext", "cov_group_stats"} and "cov_entropy" in few.columns and "u_roll8" not in few.columns
    assert {r.family: r.n_columns for r in found.table(spark).collect()}["cov_rolls_ext"] == 0
    single, _ = budget.panel_features(df.drop("u", "v"), ["g"], "t", "y")
    assert single.count() == 24


def test_halves_are_rounded_as_the_sql_rounds_them(spark):
    """Rows of sf0.01 that lie within a bit of a half differed: F.round() takes the shortest decimal, stddev_samp() rounds in other places."""
    import duckdb

    from tessera.plans.catalogue import ORACLES, QUERIES

    data = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql("set threads = 1")
    c.sql(f"create view lineitem as select * from '{data}/lineitem.parquet'")
    names = ["g", "t", "lag_1", "roll_mean_4", "d_roll8", "x_std4", "ratio", "d_group_dev", "cov_entropy"]
    expected = sorted(map(str, c.sql(f"select {', '.join(names)} from ({ORACLES['budgeted_features']})").fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES["budgeted_features"](spark, data).select(names).collect()) == expected


def test_half_away_equals_duckdb(spark):
    import duckdb

    from tessera.plans.panels import half_away

    values = [0.04325, 0.05824999999999999, -0.04325, 0.00005, 2.5e-5, -1.5, 0.0, -0.0, 1e20, 1e305, -1e305, None, 12345.67895, 0.49999999999999994]
    got = [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(half_away(F.col("v"), 4).alias("v")).collect()]
    assert got == [None if v is None else duckdb.execute("select round(?::double, 4)", [v]).fetchone()[0] for v in values]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),)], "v double").select(half_away(F.col("v"), 4).alias("v")).collect()
    assert str(odd[0].v) == "nan" and odd[1].v == float("inf")
