"""Assembly, joins, key audits and submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import assemble, submit
from tessera.plans.panels import DAILY_T_SQL, MONTHLY_SQL, daily_ranked, monthly, rounded
from tessera.plans.registry import query


@query("left_fold_orders_customer_nation", "select o_orderkey, o_custkey as custkey, c_nationkey as nationkey, c_mktsegment, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def _(t):
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    c = t("customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"), "c_mktsegment")
    return assemble.left_fold([o, c, t("nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")])


@query("assemble_train_tables", """
with cov as (select l_suppkey as g, l_partkey as p, l_quantity as q, null::double as tax from lineitem where l_linenumber <= 3 union all select l_suppkey, l_partkey, l_quantity, l_tax from lineitem where l_linenumber > 3),
 tgt as (select p_partkey as p, p_retailprice as y from part where p_partkey % 3 <> 0)
select g, p, q, tax, y from cov left join tgt using (p)""")
def _(t):
    one, two = (t("lineitem").where(f"l_linenumber {i}").select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("tax")) for i in ("<= 3", "> 3"))
    return assemble.assemble_train([one.drop("tax"), two], [t("part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("p"), F.col("p_retailprice").alias("y"))])


@query("target_null_share", "select count(*) as n_rows, round(avg((event_id % 3 = 0)::int), 4) as null_share from events")
def _(t):
    return rounded(assemble.null_share(t("events").select(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v")), "v"))


def _train_val(t):
    p = daily_ranked(t)
    return p.where("t < 24"), p.where("t >= 24")


@query("split_concat_union", f"with {DAILY_T_SQL} select event_type, day, case when t < 24 then round(y, 4) end as y, n, t, t < 24 as is_train from panel")
def _(t):
    return rounded(assemble.stack_splits(*_train_val(t), "y"))


@query("cross_expand_groups", f"with {DAILY_T_SQL} select d.day, e.event_type from (select distinct day from panel where t >= 24) d cross join (select distinct event_type from panel where t < 24) e")
def _(t):
    train, val = _train_val(t)
    return assemble.expand_groups(val.select("day").distinct(), train, ["event_type"])


@query("coalesced_blocks", "select c_custkey, coalesce(case when c_custkey % 2 = 0 then c_acctbal end, case when c_custkey % 3 = 0 then -c_acctbal end) as b from customer")
def _(t):
    c = t("customer").select("c_custkey", F.col("c_acctbal").alias("b"))
    return assemble.coalesce_blocks(c.select("c_custkey"), c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("b", -F.col("b")), ["c_custkey"], ["b"])


@query("unmatched_keys_anti", "select distinct c_custkey as k from customer where c_custkey not in (select o_custkey from orders)")
def _(t):
    return assemble.unmatched(t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("link_ratio_semi", "select count(*) as n_ids, count(*) filter (o.k is not null) as n_linked, round(count(*) filter (o.k is not null)::double / count(*), 4) as link_ratio from (select distinct c_custkey as k from customer) c left join (select distinct o_custkey as k from orders) o on c.k = o.k")
def _(t):
    return rounded(assemble.link_ratio(t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k")), "k"))


@query("last_known_by_group", f"with {MONTHLY_SQL} select g, round(arg_max(y, t), 4) as last_known from (select g, t, case when t % 4 = 0 then null else y end as y from monthly) where y is not null group by g")
def _(t):
    return rounded(assemble.last_known(monthly(t).withColumn("y", F.when(F.col("t") % 4 != 0, F.col("y"))), ["g"], "t", "y"))


@query("scored_filter_mask", "select 'l_returnflag' as \"column\", count(distinct l_returnflag) as n_train, count(distinct l_returnflag) filter (l_returnflag <> 'N') as n_template, true as scored from lineitem union all select 'l_linestatus', count(distinct l_linestatus), count(distinct l_linestatus) filter (l_returnflag <> 'N'), count(distinct l_linestatus) filter (l_returnflag <> 'N') between 1 and count(distinct l_linestatus) - 1 from lineitem")
def _(t):
    li = t("lineitem")
    return assemble.scored_filter(li, li.where("l_returnflag <> 'N'"), ["l_returnflag", "l_linestatus"])


@query("scored_rows", "select l_returnflag, count(*) as n from lineitem where l_returnflag in (select l_returnflag from lineitem where l_returnflag <> 'N') group by 1")
def _(t):
    li = t("lineitem")
    return assemble.scored_rows(li, li.where("l_returnflag <> 'N'"), ["l_returnflag"]).groupBy("l_returnflag").agg(F.count("*").alias("n"))


_TEMPLATE = DAILY_T_SQL + ", template as (select event_type, day, (row_number() over (order by event_type, day) - 1)::int as row_id from panel where t >= 24), pred as (select v.event_type, v.day, l.y as p from panel v left join panel l on v.event_type = l.event_type and l.t = 23 where v.t >= 24 and v.t <> 27)"


def _template(t):
    train, val = _train_val(t)
    template = submit.numbered(val.select("event_type", "day"), ["event_type", "day"]).withColumn("y", F.lit(None).cast("double"))
    pred = val.where("t <> 27").select("event_type", "day").join(assemble.last_known(train, ["event_type"], "t", "y"), "event_type", "left").withColumnRenamed("last_known", "p")
    return template, pred


@query("submission_join", f"with {_TEMPLATE} select event_type, day, row_id, round(coalesce(p, 10), 4) as y from template left join pred using (event_type, day)")
def _(t):
    return rounded(submit.repair(submit.submission(*_template(t), ["event_type", "day"], "y", "p"), "y", 10.0))


@query("round_trip_audit", f"with {_TEMPLATE} select count(*) as n_rows, count(*) filter (p is null) as n_unmatched, count(*) filter (p is not null and row_id % 5 = 0) as n_different, false as passed from template left join pred using (event_type, day)")
def _(t):
    template, pred = _template(t)
    sub = submit.submission(template, pred, ["event_type", "day"], "y", "p")
    return submit.round_trip(sub.withColumn("y", F.when(F.col("row_id") % 5 == 0, F.col("y") + 2e-6).otherwise(F.col("y"))), pred, ["event_type", "day"], "y", "p")


@query("submission_stats", f"with {_TEMPLATE} select round(min(p), 4) as min, round(max(p), 4) as max, round(avg(p), 4) as mean, round(stddev_samp(p), 4) as std, count(*) filter (p is null) as n_null, count(*) filter (p < 0) as n_negative from template left join pred using (event_type, day)")
def _(t):
    template, pred = _template(t)
    return rounded(submit.stats(submit.submission(template, pred, ["event_type", "day"], "y", "p"), "y"))


@query("unseen_labels", "select distinct event_type as label from events where event_type not in (select event_type from events where event_id < 2)")
def _(t):
    e = t("events")
    return submit.unseen_labels(e, e.where("event_id < 2"), "event_type", "event_type")
