"""Profiles, roles and the period axis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import axis, features, profile, roles
from tessera.plans.panels import DAILY_SQL, daily, month_index, rounded
from tessera.plans.registry import query

_NUM = ["c_custkey", "c_nationkey", "c_acctbal"]
_TEXT = ["c_name", "c_mktsegment"]
_DTYPE = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


def _profile_sql(c: str) -> str:
    five = f"min({c})::double, max({c})::double, avg({c}::double), stddev_samp({c}::double), median({c}::double)" if c in _NUM else ", ".join(["null::double"] * 5)
    names = five.split(", ") if c not in _NUM else [f"min({c})::double", f"max({c})::double", f"avg({c}::double)", f"stddev_samp({c}::double)", f"median({c}::double)"]
    cells = ", ".join(f"round({x}, 4) as {n}" for x, n in zip(names, ("min", "max", "mean", "std", "median"), strict=True))
    return f"select '{c}' as \"column\", '{_DTYPE[c]}' as dtype, count(distinct {c}) as n_unique, count(*) filter ({c} is null) as n_null, round(100.0 * count(*) filter ({c} is null) / count(*), 2)::double as null_pct, {cells} from c"


_CUSTOMER = "with c as (select c_custkey, c_name, c_nationkey, case when c_custkey % 7 = 0 then null else c_acctbal end as c_acctbal, c_mktsegment from customer) "


def _customer(t):
    return t("customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))


@query("column_profile_customer", _CUSTOMER + " union all ".join(_profile_sql(c) for c in _DTYPE))
def _(t):
    return rounded(profile.column_profile(_customer(t)))


@query("top_values_segment", "select c_mktsegment as value, count(*) as n from customer group by 1 order by n desc, value limit 3")
def _(t):
    return profile.top_values(t("customer"), "c_mktsegment", 3)


@query("class_balance_labels", "select toxic as label, count(*) as n, round(count(*) / sum(count(*)) over (), 4)::double as share, min(count(*)) over () < 0.1 * sum(count(*)) over () as imbalanced from labels group by 1")
def _(t):
    return rounded(profile.class_balance(t("labels"), "toxic"))


@query("overall_missingness", _CUSTOMER + "select round(round(100.0 * count(*) filter (c_acctbal is null) / count(*), 2) / 5, 4)::double as missing_pct from c")
def _(t):
    return rounded(profile.overall_missingness(_customer(t)))


@query("histogram50", "with e as (select min(o_totalprice) lo, max(o_totalprice) hi from orders) select least(floor((o_totalprice - lo) * 50 / (hi - lo)), 49)::int as bin, count(*) as n from orders, e group by 1")
def _(t):
    return profile.histogram(t("orders"), "o_totalprice", 50)


@query("group_candidate_stats", """
select 'c_custkey' as "column", count(distinct c_custkey) as n_unique, round(count(distinct c_custkey)::double / count(*), 4) as ratio, false as candidate from customer
union all select 'c_name', count(distinct c_name), round(count(distinct c_name)::double / count(*), 4), false from customer
union all select 'c_nationkey', count(distinct c_nationkey), round(count(distinct c_nationkey)::double / count(*), 4), false from customer
union all select 'c_acctbal', count(distinct c_acctbal), round(count(distinct c_acctbal)::double / count(*), 4), false from customer
union all select 'c_mktsegment', count(distinct c_mktsegment), round(count(distinct c_mktsegment)::double / count(*), 4), true from customer""")
def _(t):
    return rounded(roles.group_candidates(t("customer")))


@query("id_like_columns", """
select 'p_partkey' as "column", count(distinct p_partkey) as n_unique, max(p_partkey) - min(p_partkey) + 1 = count(distinct p_partkey) as contiguous, count(distinct p_partkey) >= 0.95 * count(*) as id_like from part
union all select 'p_size', count(distinct p_size), max(p_size) - min(p_size) + 1 = count(distinct p_size), count(distinct p_size) >= 0.95 * count(*) from part""")
def _(t):
    return roles.id_like(t("part"))


@query("cardinality_gate", " union all ".join(
    f"select '{c}' as \"column\", count(distinct {c}) as n_unique, {str(n).lower()} as numeric, {'true' if n else f'count(distinct {c}) <= 50'} as kept from part"
    for c, n in (("p_partkey", True), ("p_name", False), ("p_brand", False), ("p_type", False), ("p_size", True), ("p_retailprice", True))))
def _(t):
    return roles.cardinality_gate(t("part"))


@query("target_inference", """
with f as (select 'o_totalprice' as "column", count(distinct o_totalprice) as n_unique, true as numeric, 1 as pick from orders
 union all select 'o_orderstatus', count(distinct o_orderstatus), false, 0 from orders
 union all select 'o_custkey', count(distinct o_custkey), true, 0 from orders)
select "column", n_unique, numeric, row_number() over (order by pick desc, n_unique desc, "column")::int as position from f""")
def _(t):
    train = t("orders").drop("o_orderpriority", "o_orderdate")
    return roles.infer_target(train, train.select("o_orderkey"))


@query("file_like_pages_url", "select round(avg((lower(url) similar to '.*[.](png|jpg|jpeg|gif|bmp|tif|tiff|webp|wav|mp3|mp4|pdf|npz|npy|h5|parquet)')::int), 4) as share, avg((lower(url) similar to '.*[.](png|jpg|jpeg|gif|bmp|tif|tiff|webp|wav|mp3|mp4|pdf|npz|npy|h5|parquet)')::int) >= 0.5 as file_like from pages")
def _(t):
    return rounded(roles.file_like(t("pages"), "url"))


@query("parse_rates", "select round(avg((try_cast(x as timestamp) is not null)::int), 4) as dates, round(avg((try_cast(x as double) is not null)::int), 4) as numbers from (select case when event_id % 4 = 0 then 'n/a' when event_id % 4 = 1 then '12.5' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as x from events)")
def _(t):
    x = F.when(F.col("event_id") % 4 == 0, "n/a").when(F.col("event_id") % 4 == 1, "12.5").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return rounded(roles.parse_rate(t("events").select(x.alias("x")), "x"))


@query("column_kinds", " union all ".join(f"select '{c}' as \"column\", case when count(distinct {c}) = 2 then 'binary' else '{k}' end as kind from lineitem" for c, k in (("l_linestatus", "text"), ("l_returnflag", "text"), ("l_quantity", "numeric"))))
def _(t):
    return roles.column_kinds(t("lineitem"), ["l_linestatus", "l_returnflag", "l_quantity"])


_SPLIT = "m as (select o_orderpriority as g, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::int as t from orders)"


def _split(t):
    m = t("orders").select(F.col("o_orderpriority").alias("g"), month_index("o_orderdate"))
    return m.where("t < 64"), m.where("t >= 60")


@query("period_rank_orders_month", f"with {_SPLIT} select t, (dense_rank() over (order by t) - 1)::int as period_rank from (select distinct t from m)")
def _(t):
    return axis.period_rank(*_split(t), "t")


@query("horizon_steps", f"with {_SPLIT} select step, min(step) over () as gap from (select distinct t - (select max(t) from m where t < 64) as step from m where t >= 60) where step > 0 order by step limit 20")
def _(t):
    return axis.horizons(*_split(t), "t")


@query("opaque_ordinal", f"with {_SPLIT}, o as (select md5(t::varchar) as id, min((t >= 64)::int) as new from m where t < 64 or t >= 60 group by 1) select id, new, (dense_rank() over (order by new, id) - 1)::int as period_rank from o")
def _(t):
    return axis.opaque_rank(*(d.select(F.md5(F.col("t").cast("string")).alias("id")) for d in _split(t)), "id")


@query("rank_attach_guard", f"with {DAILY_SQL} select event_type, day, n, (dense_rank() over (order by day) - 1)::int as period_rank from daily")
def _(t):
    d = daily(t).select("event_type", "day", "n")
    return axis.attach_rank(d, axis.period_rank(d, d, "day"), "day")


_GAPS = "g as (select gap from (select user_id, h, h - lag(h) over (partition by user_id order by h) as gap from (select distinct user_id, floor(epoch(ts) / 3600)::bigint as h from events)) where gap is not null)"


def _gaps(t):
    h = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("h")
    return axis.period_gaps(t("events").select("user_id", h), "h", ["user_id"])


@query("period_gaps", f"with {_GAPS} select gap, count(*) as n from g group by 1")
def _(t):
    return _gaps(t).groupBy("gap").agg(F.count("*").alias("n"))


@query("granularity_stats_events", f"""
with {_GAPS}, c as (select gap, count(*) as n from g group by 1),
 s as (select median(gap)::double as median_gap, stddev_samp(gap) / avg(gap) as variation from g),
 m as (select gap as modal_gap, n::double / (select sum(n) from c) as modal_share from c order by n desc, gap limit 1)
select median_gap, modal_gap, round(modal_share, 4)::double as modal_share, round(variation, 4) as variation, modal_share < 0.6 or variation > 0.5 as irregular from s, m""")
def _(t):
    return rounded(axis.cadence(_gaps(t)))


@query("codebook_dates", f"""
with {DAILY_SQL}, b as (select md5(day::varchar) as id, day from (select distinct day from daily) where day(day) <> 7),
 j as (select md5(d.day::varchar) as id, d.event_type, b.day as date from daily d left join b on md5(d.day::varchar) = b.id)
select event_type, id, coalesce(month(date)::double, (select median(month(date)) from j)) as month, quarter(date)::int as quarter, coalesce(month(date) % 3 = 1 and day(date) = 1, false) as is_quarter_start from j""")
def _(t):
    d = daily(t)
    ident = F.md5(F.col("day").cast("string"))
    spark = d.sparkSession
    entries = {r.id: str(r.day) for r in d.where(F.dayofmonth("day") != 7).select(ident.alias("id"), "day").distinct().collect()}
    return axis.codebook_features(d.select("event_type", ident.alias("id")), axis.codebook(spark, entries), "id")


@query("feature_contract", """
with c as (select c_custkey, c_mktsegment, c_nationkey, case when c_custkey % 7 = 0 then null else c_acctbal end as b, 'n' || c_custkey as name from customer)
select * from (values ('b', true, true, false), ('c_mktsegment', false, false, true), ('c_nationkey', false, false, true), ('name', false, false, (select count(distinct name) <= 50 from c where c_custkey % 4 <> 0))) v("column", "impute", "scale", "encode")""")
def _(t):
    c = t("customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("b"), F.concat(F.lit("n"), "c_custkey").alias("name"), F.col("c_acctbal").alias("y"))
    return features.contract(c.where("c_custkey % 4 <> 0"), c.where("c_custkey % 4 = 0").drop("y"), "y", ["c_nationkey"], ("c_custkey",))


@query("generic_ranks_numbers", "select p, (dense_rank() over (order by n) - 1)::int as period_rank from (select distinct l_linenumber::varchar || '0' as p, l_linenumber * 10 as n from lineitem)")
def _(t):
    p = t("lineitem").select(F.concat(F.col("l_linenumber").cast("string"), F.lit("0")).alias("p"))
    return axis.generic_ranks(p, p.limit(0), "p")


@query("generic_ranks_dates", "select strftime(d, '%d %b %Y') as label, strftime(d, '%Y-%m-%d') as p, (dense_rank() over (order by d) - 1)::int as period_rank from (select distinct cast(ts as date) as d from events)")
def _(t):
    p = t("events").select(F.date_format("ts", "yyyy-MM-dd").alias("p"))
    return axis.generic_ranks(p, p.limit(0), "p").select(F.date_format(F.to_date("p"), "dd MMM yyyy").alias("label"), "p", "period_rank")
