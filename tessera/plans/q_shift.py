"""Distribution shift, correlation, moments and percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import shift
from tessera.plans.panels import MONTHLY_SQL, monthly, rounded
from tessera.plans.registry import query

_COLS = ("o_totalprice", "o_custkey")


@query("ks_two_sample", """
with v as (select unnest([{'feature': 'o_totalprice', 'value': o_totalprice}, {'feature': 'o_custkey', 'value': o_custkey::double}], recursive := true), (o_orderdate >= timestamp '2000-01-01')::int as side from orders),
 c as (select feature, value, count(*) filter (side = 0) as x, count(*) filter (side = 1) as y from v group by 1, 2),
 s as (select feature, sum(x) over w as cx, sum(y) over w as cy, sum(x) over (partition by feature) as nx, sum(y) over (partition by feature) as ny from c window w as (partition by feature order by value rows unbounded preceding)),
 d as (select feature, max(abs(cx::double / nx - cy::double / ny)) as statistic, max(nx)::bigint as n_a, max(ny)::bigint as n_b from s group by 1),
 p as (select *, n_a::double * n_b / (n_a + n_b) as n from d), q as (select *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * statistic as lam from p)
select feature, round(statistic, 4) as statistic, n_a, n_b, round(least(greatest(2 * exp(-2 * lam * lam), 0), 1), 4) + 0.0 as p_value, statistic > 0.15 and least(2 * exp(-2 * lam * lam), 1) < 0.01 as flagged from q""")
def _(t):
    o = t("orders")
    late = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    return rounded(shift.ks(o.where(~late), o.where(late), list(_COLS)))


def _ms(a: str, b: str) -> str:
    return f"case when n_{a} >= 5 and n_{b} >= 5 then coalesce(abs(m_{a} - m_{b}) / nullif(sqrt((s_{a} + s_{b}) / 2), 0), 0) end"


_STATS = "avg({c}) filter ({w}) as m_{k}, var_pop({c}) filter ({w}) as s_{k}, count({c}) filter ({w}) as n_{k}"


@query("mean_shift", f"with {MONTHLY_SQL} " + " union all ".join(f"select '{c}' as feature, round({_ms('f', 'v')}, 4) + 0.0 as shift from (select {_STATS.format(c=c, w='t < 64', k='f')}, {_STATS.format(c=c, w='t >= 64', k='v')} from monthly)" for c in ("y", "d", "x")))
def _(t):
    m = monthly(t)
    return rounded(shift.standardised_shift(m.where("t < 64"), m.where("t >= 64"), ["y", "d", "x"]))


_DRIFT = f"{MONTHLY_SQL}, drift as (" + " union all ".join(f"select '{c}' as feature, {_ms('f', 'v')} as full_shift, {_ms('r', 'v')} as recent_shift from (select {_STATS.format(c=c, w='t < 64', k='f')}, {_STATS.format(c=c, w='t < 64 and t > 63 - 14', k='r')}, {_STATS.format(c=c, w='t >= 64', k='v')} from monthly)" for c in ("y", "d", "x")) + ")"


def _drift(t):
    m = monthly(t)
    return shift.drift(m.where("t < 64"), m.where("t >= 64"), ["y", "d", "x"], "t")


@query("drift_recent_vs_full", f"with {_DRIFT} select feature, round(full_shift, 4) + 0.0 as full_shift, round(recent_shift, 4) + 0.0 as recent_shift from drift")
def _(t):
    return rounded(_drift(t))


@query("drift_gate", f"with {_DRIFT} select count(*) as n_features, round((avg(full_shift) - avg(recent_shift)) / avg(full_shift), 3) + 0.0 as rel, round(avg((full_shift - recent_shift > 0.05)::int), 3) as frac_improved, false as sliding from drift")
def _(t):
    return rounded(shift.drift_gate(_drift(t)), 3)


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("pearson_pairs", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 4) + 0.0 as corr from lineitem" for i, a in enumerate(_LI) for b in _LI[i + 1 :]))
def _(t):
    return rounded(shift.correlations(t("lineitem"), _LI))


@query("signal_test", " union all ".join(f"select '{c}' as feature, round(abs(corr({c}, l_extendedprice)), 4) as abs_corr, abs(corr({c}, l_extendedprice)) >= 0.05 as has_signal from lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def _(t):
    return rounded(shift.signal(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


@query("skewness_pop", "with v as (select unnest([{'feature': 'c_acctbal', 'v': c_acctbal}, {'feature': 'c_nationkey', 'v': c_nationkey::double}], recursive := true) from customer), m as (select feature, avg(v) as mu from v group by 1) select feature, round(avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5), 4) + 0.0 as skewness from v join m using (feature) group by 1")
def _(t):
    return rounded(shift.moments(t("customer"), ["c_acctbal", "c_nationkey"]))


@query("percentiles", "select " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 3) as p{round(p * 100):02d}" for p in (0.01, 0.25, 0.75, 0.99)) + " from orders")
def _(t):
    return rounded(shift.percentiles(t("orders"), "o_totalprice"), 3)


@query("adv_weights_from_scores", "with s as (select p_partkey, (p_partkey % 97) / 97.0::double as p from part), r as (select p_partkey, least(greatest(1 - p, 0.1), 10) as w from s) select p_partkey, round(w / (select avg(w) from r), 4) as weight from r")
def _(t):
    s = t("part").select("p_partkey", (F.col("p_partkey") % 97 / 97.0).alias("p"))
    return rounded(shift.weights_from_scores(s, "p", 0.7).select("p_partkey", "weight"))


