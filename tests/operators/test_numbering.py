import csv
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import folds, submit
from tessera.sources import readers


@pytest.mark.parametrize("keys", [["a"], ["a", "b"]])
def test_numbers_follow_the_keys(spark, keys):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]) if i % 3 else 7, rng.random(), f"x{i}") for i in range(900)] + [(7, 0.5, "same")] * 300
    df = spark.createDataFrame(rows, "a int, b double, row_name string").repartition(5)
    got = sorted(submit.numbered(df, keys).collect(), key=lambda r: r.row_id)
    assert [r.row_id for r in got] == list(range(1200)) and sorted(map(str, (r[:3] for r in got))) == sorted(map(str, rows))
    order = [tuple((r[k] is not None, r[k] or 0) for k in keys) for r in got]
    assert order == sorted(order)
    down = sorted(submit.numbered(df, [F.desc("b")]).collect(), key=lambda r: r.row_id)
    assert [r.b for r in down] == sorted((r[1] for r in rows), reverse=True)


def test_numbers_of_no_rows_and_plans_without_a_window(spark):
    df = spark.createDataFrame([], "a int, m map<string,int>")
    assert submit.numbered(df, ["a"]).collect() == []
    plan = submit.numbered(spark.range(50).toDF("a"), ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_one_key_for_all_rows_is_parted(spark):
    sizes = [r["count"] for r in submit.ordered_shards(spark.range(4000).select(F.lit(1).alias("k"), F.lit("x").alias("v")), ["k"], 8).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_shards_are_the_table_in_order(spark, tmp_path):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.lit("v").alias("v"))
    readers.write_csv(df, f"{tmp_path}/out", ["k"], 6)
    files = sorted(Path(f"{tmp_path}/out").glob("part-*.csv"))
    read = [int(r["k"]) for f in files for r in csv.DictReader(f.open())]
    assert len(files) == 6 and read == list(range(500))
    readers.write_csv(df, f"{tmp_path}/one", ["k"], 1)
    assert len(list(Path(f"{tmp_path}/one").glob("part-*.csv"))) == 1


def greedy(sizes, k):
    loads, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = loads.index(min(loads))
        out[g], loads[f] = f, loads[f] + n
    return out, loads


@pytest.mark.parametrize("seed", range(6))
def test_turns_equal_one_by_one_dealing(seed):
    rng = random.Random(seed)
    for _ in range(200):
        loads, size, n = [rng.randrange(60) for _ in range(rng.randrange(2, 6))], rng.randrange(1, 9), rng.randrange(40)
        plain, want = list(loads), []
        for _ in range(n):
            want.append(plain.index(min(plain)))
            plain[want[-1]] += size
        parts = folds.turns(loads, size)
        got = []
        for i in range(n):
            start, order = [p for p in parts if p[0] <= i][-1]
            got.append(order[(i - start) % len(order)])
        assert got == want and folds.dealt(loads, size, n) == plain and len(parts) <= len(loads)


def test_groups_go_to_the_lightest_fold(spark):
    rng = random.Random(4)
    sizes = {f"g{i:03d}": rng.choice([1, 1, 1, 2, 2, 5, 9, 40]) for i in range(120)} | {"big": 300}
    rows = [(g, i) for g, n in sizes.items() for i in range(n)]
    got = folds.group_folds(spark.createDataFrame(rows, "g string, i int"), "g", 4)
    by = {r.g: r.fold_id for r in got.select("g", "fold_id").distinct().collect()}
    want, loads = greedy(sizes, 4)
    assert by == want and got.count() == len(rows)
    assert max(loads) - min(loads) <= 300


def test_few_groups_null_groups_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "g string, i int")
    assert {(r.g, r.fold_id) for r in folds.group_folds(df, "g").collect()} == {("a", 0), (None, 1)}
    assert folds.group_folds(df.limit(0), "g").count() == 0
