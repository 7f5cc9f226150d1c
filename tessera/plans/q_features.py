"""Seasonal, covariate and cross-sectional feature families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.expr import log1p_floor
from tessera.operators import features
from tessera.plans.panels import DAILY_SQL, DAILY_T_SQL, MONTHLY_SQL, daily, daily_ranked, monthly, month_index, rounded
from tessera.plans.registry import query


def _cyc(x: str, period: float, name: str, orders: int = 1) -> str:
    out = []
    for h in range(1, orders + 1):
        tag = name if h == 1 else f"{name}{h}"
        out += [f"round({f}(({x}) * {2 * h} * pi() / {period}), 4) + 0.0 as {tag}_{f}" for f in ("sin", "cos")]
    return ", ".join(out)


@query("seasonality_fourier", f"with {MONTHLY_SQL} select g, t, {_cyc('t % 12', 12, 'annual', 2)} from monthly")
def _(t):
    return rounded(monthly(t).select("g", "t", *features.annual("t", 12)))


@query("relative_time", f"with {MONTHLY_SQL} select g, t, round((t - min(t) over ())::double / greatest(max(t) over () - min(t) over (), 1), 4) as relative_time from monthly")
def _(t):
    return rounded(features.relative_time(monthly(t).select("g", "t"), "t"))


@query("hourly_cyclic", f"select event_id, {_cyc('hour(ts)', 24, 'hour', 2)}, {_cyc('(isodow(ts) - 1)', 7, 'dow')} from events")
def _(t):
    return rounded(t("events").select("event_id", *features.calendar("ts", "hourly")))


@query("daily_cyclic", f"with {DAILY_SQL} select event_type, day, {_cyc('(isodow(day) - 1)', 7, 'dow')}, {_cyc('month(day) % 12', 12, 'month')}, {_cyc('weekofyear(day) % 52', 52, 'week')} from daily")
def _(t):
    return rounded(daily(t).select("event_type", "day", *features.calendar("day", "daily")))


@query("monthly_cyclic", f"select o_orderkey, {_cyc('month(o_orderdate) % 12', 12, 'month')}, quarter(o_orderdate)::int as quarter from orders")
def _(t):
    return rounded(t("orders").select("o_orderkey", *features.calendar("o_orderdate", "monthly")))


@query("time_derived", f"with {MONTHLY_SQL} select g, t % 52 as cycle_pos, (t % 52) // 13 as cycle_quarter, (t % 52) // 4 as cycle_month, t as trend from monthly")
def _(t):
    return monthly(t).select("g", *features.time_derived("t"))


@query("hour_dow_baselines", "select 'hour' as part, event_type, hour(ts)::int as slot, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std from events group by 2, 3 union all select 'dow', event_type, (isodow(ts) - 1)::int, round(avg(value), 6), round(stddev_samp(value), 6) from events group by 2, 3")
def _(t):
    e = t("events")
    parts = [features.baselines(e, ["event_type"], p, "value", n).select(F.lit(n).alias("part"), "event_type", F.col(n).cast("int").alias("slot"), F.col(f"{n}_mean").alias("mean"), F.col(f"{n}_std").alias("std")) for n, p in (("hour", F.hour("ts")), ("dow", F.weekday("ts")))]
    return rounded(parts[0].union(parts[1]), 6)


@query("cov_ratios", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice / (abs(l_discount) + 1e-9), 0) as l_extendedprice_over_l_discount, round(l_quantity / (abs(l_extendedprice) + 1e-9), 6) as l_quantity_over_l_extendedprice from lineitem")
def _(t):
    li = t("lineitem")
    pairs = features.ratio_pairs(li, ["l_extendedprice", "l_discount"]) + features.ratio_pairs(li, ["l_quantity", "l_extendedprice"])
    out = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *features.ratios(pairs))
    return out.withColumns({"l_extendedprice_over_l_discount": F.round("l_extendedprice_over_l_discount", 0), "l_quantity_over_l_extendedprice": F.round("l_quantity_over_l_extendedprice", 6)})


_PARTS = ("l_quantity", "l_discount", "l_tax")
_TOTAL = " + ".join(f"greatest({c}, 0)" for c in _PARTS)
_SHARE = {c: f"(case when {_TOTAL} > 0 then greatest({c}, 0) / ({_TOTAL}) else 1.0 / 3 end)" for c in _PARTS}


@query("cov_entropy", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(-(" + " + ".join(f"{s} * ln({s} + 1e-9)" for s in _SHARE.values()) + "), 4) + 0.0 as l_entropy from (select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_linenumber = 1 then 0 else l_quantity end as l_quantity, case when l_linenumber = 1 then 0 else l_discount end as l_discount, case when l_linenumber = 1 then 0 else l_tax end as l_tax from lineitem)")
def _(t):
    li = t("lineitem").withColumns({c: F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col(c)) for c in _PARTS})
    return rounded(li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", features.prefix_entropy(list(_PARTS), "l_entropy")))


@query("interactions", "select p_partkey, round(p_retailprice * f, 4) as p_retailprice_x_f, round(s * f, 4)::double as s_x_f, f * h as f_x_h, round(p_retailprice * p_retailprice, 2) as p_retailprice_sq, round(s * s, 2)::double as s_sq, round(p_retailprice * s, 2) as p_retailprice_x_s from (select p_partkey, p_retailprice, p_size::double as s, (p_size % 2)::int as f, (p_partkey % 3 = 0)::int as h from part)")
def _(t):
    p = t("part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("s"), (F.col("p_size") % 2).alias("f"), (F.col("p_partkey") % 3 == 0).cast("int").alias("h"))
    out = p.select("p_partkey", *features.interactions(["p_retailprice", "s"], ["f", "h"], squares=True, products=True)).drop("p_retailprice_x_h", "s_x_h")
    two = {c: F.round(c, 2) for c in ("p_retailprice_sq", "s_sq", "p_retailprice_x_s")}
    return out.withColumns(two | {c: F.round(c, 4) for c in ("p_retailprice_x_f", "s_x_f")})


@query("threshold_flags", "select p_partkey, (p_size >= 30)::int as p_size_ge_30, (p_size >= 45)::int as p_size_ge_45, (p_size < 10)::int as p_size_lt_10, (p_size // 10)::bigint as p_size_bucket from part")
def _(t):
    return t("part").select("p_partkey", *features.thresholds("p_size", (30, 45), (10,), 10))


@query("power_features", "select p_partkey, p_size * p_size * p_size as p_size_cube, round(sqrt(greatest(p_size, 0)), 4) as p_size_sqrt, round(ln(1 + greatest(p_size, 0)), 4) as p_size_log1p from part")
def _(t):
    return rounded(t("part").select("p_partkey", *features.powers("p_size")))


@query("compound_scores", "select p_partkey, round(p_size / 100.0 * p_retailprice, 3) as p_size_p_retailprice_compound, round((p_size / 100.0 * p_retailprice) * (p_size / 100.0 * p_retailprice), 1) as p_size_p_retailprice_compound_sq from part")
def _(t):
    a, b = features.compound("p_size", "p_retailprice")
    return t("part").select("p_partkey", F.round(a, 3).alias("p_size_p_retailprice_compound"), F.round(b, 1).alias("p_size_p_retailprice_compound_sq"))


@query("log1p_features", "select c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 4) as log_bal from (select c_custkey, case when c_custkey % 7 = 0 then null else c_acctbal end as c_acctbal from customer where c_custkey % 7 <> 0) union all select c_custkey, null from customer where c_custkey % 7 = 0")
def _(t):
    c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("b"))
    return rounded(c.select("c_custkey", log1p_floor("b").alias("log_bal")))


@query("horizon_feature", f"with {DAILY_T_SQL} select event_type, t, greatest(t - 23, 0) as horizon from panel")
def _(t):
    return daily_ranked(t).select("event_type", "t", features.horizon("t", F.lit(23)))


@query("month_panel_orders", "select o_orderpriority, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::int as t, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1, 2")
def _(t):
    return t("orders").groupBy("o_orderpriority", month_index("o_orderdate")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
