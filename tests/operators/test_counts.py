import math
import random
import statistics
from collections import Counter
from decimal import Decimal

import pytest

from tessera.operators import counts, profile, roles

SCHEMA = "k long, x double, s string, d decimal(8,2), b boolean, t date, a array<int>, n int"


def rows():
    import datetime

    rng = random.Random(3)
    out = []
    for i in range(500):
        x = rng.choice([None, float("nan"), 0.0, -0.0, 1.5, float(i), 1e15 + i])
        out.append((i, x, rng.choice([None, "", "a", "b", "2024-01-05", "12"]), Decimal(rng.randrange(400)) / 4, rng.choice([True, False, None]), datetime.date(2024, 1, 1 + i % 28), [i % 3, None], None))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4)


def plain(column):
    """Value -> count, with -0.0 and 0.0 as one and all NaN as one."""
    out = Counter()
    for r in rows():
        v = r[column]
        if isinstance(v, float):
            v = "nan" if math.isnan(v) else v + 0.0
        out[tuple(v) if isinstance(v, list) else v] += 1
    return out


@pytest.mark.parametrize("held", [1 << 18, 20])
def test_counts_equal_plain_ones(df, monkeypatch, held):
    monkeypatch.setattr(counts, "HELD", held)
    c = counts.Counts.of(df)
    got = {}
    for r in c.table.collect():
        got.setdefault(r["column"], []).append(r)
    for i, name in enumerate(df.columns):
        want = plain(i)
        assert sorted(r.n for r in got[name]) == sorted(want.values()) and len({r.value for r in got[name]}) == len(want)
        assert sum(r.n for r in got[name] if r.value is None) == want[None]
    numbers = {r.number: r.n for r in got["x"] if r.number is not None and not math.isnan(r.number)}
    assert numbers == {k: n for k, n in plain(1).items() if k is not None and k != "nan"}


def test_profile_equals_plain_numbers(df):
    got = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert list(got) and set(got) == set(df.columns) and got["d"].dtype == "decimal(8,2)"
    for i, name in enumerate(df.columns):
        want = plain(i)
        assert (got[name].n_unique, got[name].n_null) == (len(set(want) - {None}), want[None])
        assert got[name].null_pct == round(100 * want[None] / 500, 2)
    for name, i in (("k", 0), ("x", 1), ("d", 3)):
        values = [float(r[i]) for r in rows() if r[i] is not None and not math.isnan(r[i])]
        r = got[name]
        assert (r.min, r.max) == (min(values), max(values)) and math.isclose(r.median, statistics.median(values), abs_tol=1e-9)
        assert math.isclose(r.mean, statistics.fmean(values), rel_tol=1e-12) and math.isclose(r.std, statistics.stdev(values), rel_tol=1e-9)
    assert got["n"].median is None and got["n"].n_unique == 0 and got["s"].mean is None


def test_one_table_serves_all(df):
    c = counts.Counts.of(df)
    assert {r["column"]: r.id_like for r in roles.id_like(c).collect()} == {"k": True, "n": False}
    assert roles.find_id(c) == "k" and roles.find_time(c) == "t" and roles.find_id(c, ("k",)) is None
    assert {r["column"] for r in roles.cardinality_gate(c).where("kept").collect()} == {"k", "x", "s", "d", "b", "t", "a", "n"}
    want = sorted(((v, n) for v, n in plain(2).items()), key=lambda p: (-p[1], p[0] is not None, p[0] or ""))[:3]
    assert [tuple(r) for r in profile.top_values(c, "s", 3).collect()] == want
    rates = {r["column"]: (r.dates, r.numbers) for r in c.parse_rates(["s"]).collect()}
    seen = [r[2] for r in rows() if r[2] is not None]
    assert math.isclose(rates["s"][1], sum(v == "12" for v in seen) / len(seen)) and rates["s"][0] >= sum(v == "2024-01-05" for v in seen) / len(seen)


def test_an_id_by_name_must_number_the_rows(spark):
    df = spark.createDataFrame([(str(i), i % 2, i) for i in range(20)], "id string, index int, number int")
    assert roles.find_id(df) == "number"
    assert roles.find_id(df.drop("number")) is None


def test_plans_do_not_multiply_rows(spark, df):
    """Neither the counts nor what is read from them expands or generates rows by columns."""
    made = []
    original = counts.Counts.of

    c = original(df)
    for d in (c.facts(), c.moments(), c.medians(), c.profile(), roles.uniqueness(c)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        made.append(plan)
        assert "Expand" not in plan and "Generate" not in plan
    assert made


def test_empty_and_odd_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    got = profile.column_profile(empty).collect()
    assert len(got) == 8 and all(r.n_unique == 0 and r.null_pct is None for r in got)
    odd = spark.createDataFrame([(1, "x")], "`a.b` int, `c d` string")
    assert {r["column"]: r.n_unique for r in profile.column_profile(odd).collect()} == {"a.b": 1, "c d": 1}
