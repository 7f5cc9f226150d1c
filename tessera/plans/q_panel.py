"""Window features of panels."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.operators import assemble, features
from tessera.plans.panels import DAILY_SQL, DAILY_T_SQL, MONTHLY_SQL, daily, daily_ranked, monthly, rounded
from tessera.plans.registry import query

_G = "partition by g order by t"


def _r(x: str, n: str, digits: int = 4) -> str:
    return f"round({x}, {digits}) + 0.0 as {n}"


@query("panel_lags", f"with {MONTHLY_SQL} select g, t, " + ", ".join(_r(f"lag(y, {k}) over ({_G})", f"lag_{k}") for k in (1, 2, 3, 4, 8, 12, 26, 52)) + " from monthly")
def _(t):
    return rounded(monthly(t).select("g", "t", *features.lags("y", ["g"], "t", [1, 2, 3, 4, 8, 12, 26, 52])))


def _roll(f: str, c: str, n: int) -> str:
    return f"{f}({c}) over ({_G} rows between {n} preceding and 1 preceding)"


_ROLLS = ", ".join(_r(_roll(f, "y", n), f"roll_{k}_{n}") for n in (4, 8, 13, 26) for f, k in (("avg", "mean"), ("stddev_samp", "std")))


@query("panel_rolls_monthly", f"with {MONTHLY_SQL} select g, t, {_ROLLS} from monthly")
def _(t):
    return rounded(monthly(t).select("g", "t", *features.rolls("y", ["g"], "t", [4, 8, 13, 26])))


@query("panel_roll_mean_std", f"with {DAILY_SQL} select event_type, day, n, round(y, 4) as y, round(lag(y) over w, 4) as lag_1, round(avg(y) over (w rows between 4 preceding and 1 preceding), 4) as roll_mean_4, round(stddev_samp(y) over (w rows between 4 preceding and 1 preceding), 4) as roll_std_4 from daily window w as (partition by event_type order by day)")
def _(t):
    return rounded(daily(t).select("event_type", "day", "n", "y", *features.lags("y", ["event_type"], "day", [1]), *features.rolls("y", ["event_type"], "day", [4])))


@query("series_without_groups", "with s as (select cast(ts as date) as day, sum(value) as y from events group by 1) select day, round(lag(y) over (order by day), 4) as lag_1 from s")
def _(t):
    s = t("events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))
    return rounded(s.select("day", *features.lags("y", [], "day", [1])))


@query("cov_lag_delta_roll", f"with {MONTHLY_SQL} select g, t, {_r(f'lag(d) over ({_G})', 'd_lag1', 9)}, {_r(f'd - lag(d) over ({_G})', 'd_delta', 9)}, {_r(_roll('avg', 'd', 4), 'd_roll4', 9)} from monthly")
def _(t):
    return rounded(monthly(t).select("g", "t", *features.covariate_dynamics(["d"], ["g"], "t")), 9)


@query("cov_roll_ext", f"with {MONTHLY_SQL} select g, t, " + ", ".join([_r(_roll("avg", "x", n), f"x_roll{n}", 9) for n in (8, 13)] + [_r(_roll("stddev_samp", "x", n), f"x_std{n}", 9) for n in (4, 8)]) + " from monthly")
def _(t):
    return rounded(monthly(t).select("g", "t", *features.covariate_dynamics(["x"], ["g"], "t", True)[3:]), 9)


@query("rolling_zscore", f"with {MONTHLY_SQL}, z as (select g, t, y, avg(y) over (w rows between 3 preceding and current row) m, stddev_samp(y) over (w rows between 3 preceding and current row) s from monthly window w as ({_G})) select g, t, round((y - m) / nullif(s, 0), 4) + 0.0 as y_z from z")
def _(t):
    return rounded(monthly(t).select("g", "t", features.rolling_z("y", ["g"], "t")))


@query("shift_aware_features", f"""with {MONTHLY_SQL}, z as (select g, t, y, avg(y) over (partition by g) as gm, avg(y) over (w rows between 3 preceding and current row) m, stddev_samp(y) over (w rows between 3 preceding and current row) s, avg(y) over () as am, stddev_samp(y) over () as sd from monthly window w as ({_G}))
select g, t, round((y - am) / sd, 3) + 0.0 as y_global_z, round((y - m) / nullif(s, 0), 3) + 0.0 as y_z, round(y - gm, 3) + 0.0 as y_group_dev, round(y * t, 3) as y_x_time from z""")
def _(t):
    return rounded(features.shift_aware(monthly(t).select("g", "t", "y"), "y", ["g"], "t").drop("y"), 3)


@query("dense_rank_groups", f"with {MONTHLY_SQL} select g, round(avg(y), 4) as group_mean, dense_rank() over (order by avg(y) desc)::int as group_rank from monthly group by g")
def _(t):
    from tessera.operators.encode import relational_stats

    return rounded(relational_stats(monthly(t), "g", "y").select("g", "group_mean", "group_rank"))


@query("ecdf_rank", "with v as (select p_partkey, p_size as v from part), c as (select v, count(*) filter (p_partkey % 3 <> 0) as n from v group by 1) select p_partkey, p_size, round((select sum(n) from c where c.v <= part.p_size)::double / (select sum(n) from c), 4) as ecdf from part where p_partkey % 3 = 0")
def _(t):
    p = t("part").select("p_partkey", "p_size")
    return rounded(features.ecdf(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 3 = 0"), "p_size"))


@query("category_codes", "select o_orderkey, o_orderpriority, coalesce(dense_rank() over (order by p nulls last) - 1, -1)::int as code from (select o_orderkey, o_orderpriority, o_orderpriority as p from orders where o_orderkey % 5 <> 0) union all select o_orderkey, null, -1 from orders where o_orderkey % 5 = 0")
def _(t):
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return features.category_codes(o.where("o_orderkey % 2 = 0"), o, "o_orderpriority").withColumnRenamed("o_orderpriority_code", "code")


@query("min_group_length", f"with {MONTHLY_SQL} select min(n) as min_periods, round(avg(n), 4) as mean_periods from (select g, count(*) as n from monthly group by g)")
def _(t):
    return rounded(monthly(t).groupBy("g").agg(F.count("*").alias("n")).agg(F.min("n").alias("min_periods"), F.avg("n").alias("mean_periods")))


@query("adaptive_depth_panel", f"with {MONTHLY_SQL} select g, t, round(lag(y, 52) over ({_G}), 4) as lag_52, {_r(_roll('avg', 'y', 26), 'roll_mean_26')} from monthly")
def _(t):
    m = monthly(t)
    d = features.depths(features.min_periods(m, ["g"]))
    out = m.select("g", "t", *features.lags("y", ["g"], "t", d["lags"]), *features.rolls("y", ["g"], "t", d["rolls"]))
    return rounded(out.select("g", "t", "lag_52", "roll_mean_26"))


_CYCLE = DAILY_T_SQL + """, train as (select * from panel where t < 23), means as (select event_type, t % 7 as place, avg(y) as m from train group by 1, 2),
 last as (select event_type, arg_max(y, t) as last from train group by 1)"""


@query("cycle_lag_impute_dow", f"with {_CYCLE} select v.event_type, v.t, round(coalesce(m, last), 4) as lag_3 from panel v left join means on v.event_type = means.event_type and (v.t - 3) % 7 = place left join last on v.event_type = last.event_type where v.t >= 23")
def _(t):
    p = daily_ranked(t)
    out = features.impute_cycle_lag(p.where("t < 23"), p.where("t >= 23"), ["event_type"], "t", "y", 7, 3)
    return rounded(out.select("event_type", "t", "lag_3"))


@query("roll_fill_last_known", f"with {_CYCLE}, r as (select event_type, t, case when t % 2 = 0 then y end as m, case when t % 3 = 0 then y end as s from panel where t >= 23) select event_type, t, round(coalesce(m, last), 4) as m, round(coalesce(s, 0), 4) as s from r left join last using (event_type)")
def _(t):
    p = daily_ranked(t)
    last = assemble.last_known(p.where("t < 23"), ["event_type"], "t", "y")
    rows = p.where("t >= 23").select("event_type", "t", F.when(F.col("t") % 2 == 0, F.col("y")).alias("m"), F.when(F.col("t") % 3 == 0, F.col("y")).alias("s"))
    return rounded(features.impute_rolls(rows, last, ["event_type"], ["m"], ["s"]))


@query("row_numbers", f"with {DAILY_SQL} select event_type, day, (row_number() over (order by event_type, day) - 1)::int as row_id from daily")
def _(t):
    from tessera.operators.submit import numbered

    return numbered(daily(t).select("event_type", "day"), ["event_type", "day"])


@query("top_shift_features", f"with {MONTHLY_SQL} select g, round(sum(y), 4) as total from monthly group by g order by sum(y) desc, g limit 5")
def _(t):
    return rounded(monthly(t).groupBy("g").agg(F.sum("y").alias("total")).orderBy(F.desc("total"), "g").limit(5))


