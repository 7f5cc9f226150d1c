"""Folds and fold-fit encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.expr import hash_fold
from tessera.operators import encode, folds
from tessera.plans.panels import MONTHLY_SQL, PRED_SQL, monthly, predicted, rounded
from tessera.plans.registry import query


def _hash(key: str, k: int) -> str:
    return f"(('0x' || substr(md5({key}::varchar || '|42'), 1, 8))::bigint % {k})::int"


@query("folds_kfold_hash", f"select o_orderkey, {_hash('o_orderkey', 5)} as fold_id from orders")
def _(t):
    return folds.kfold(t("orders").select("o_orderkey"), "o_orderkey")


@query("folds_stratified", "select doc_id, toxic, ((row_number() over (partition by toxic order by md5(doc_id::varchar || '|42'), doc_id) - 1) % 5)::int as fold_id from labels")
def _(t):
    return folds.stratified(t("labels").select("doc_id", "toxic"), "doc_id", "toxic")


_GREEDY_SQL = (
    "s as (select {g} as g, count(*) as n from {t} group by 1), o as (select g, n, row_number() over (order by n desc, g) as i from s), k as (select greatest(2, least(5, count(*))) as k from s), "
    "r as (select 0 as i, list_transform(range(k), lambda x: 0::bigint) as loads, -1 as fold from k union all select i + 1, list_transform(range(len(loads)), lambda x: loads[x + 1] + case when x = f then n else 0 end), f "
    "from (select r.i, loads, o.n, list_position(loads, list_min(loads)) - 1 as f from r join o on o.i = r.i + 1))"
)


@query("folds_group", f"with recursive {_GREEDY_SQL.format(g='c_nationkey', t='customer')} select c_custkey, c_nationkey, fold::int as fold_id from customer join o on g = c_nationkey join r on r.i = o.i")
def _(t):
    return folds.group_folds(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey")


@query("folds_group_sizes", f"with recursive {_GREEDY_SQL.format(g='l_suppkey', t='lineitem')} select fold::int as fold_id, count(*) as n_groups, sum(n)::bigint as n_rows from o join r on r.i = o.i group by 1")
def _(t):
    """Folds of whole suppliers, many of which have as many line items as others."""
    li = folds.group_folds(t("lineitem").select("l_suppkey"), "l_suppkey")
    return li.groupBy("fold_id").agg(F.count_distinct("l_suppkey").alias("n_groups"), F.count("*").alias("n_rows"))


def _spans_sql(spans: str) -> str:
    """spans: SQL for rows (fold_id, fa, fb, fc, fd), of n, the number of periods, written without the code that makes them."""
    inside = lambda a, b: f"t >= {a} and t < {b}"
    train, valid = inside("fa", "fb"), inside("fc", "fd")
    return (
        f"with {MONTHLY_SQL}, p as (select max(t) + 1 as n from monthly), f as ({spans}) select fold_id::int as fold_id, count(*) filter ({train}) as n_train, count(*) filter ({valid}) as n_valid, "
        f"min(t) filter ({train}) as train_min, max(t) filter ({train}) as train_max, min(t) filter ({valid}) as valid_min, max(t) filter ({valid}) as valid_max from monthly, f where {train} or {valid} group by 1"
    )


# 5 folds of 6 months with a gap of 1
_EXPANDING = "select i as fold_id, 0 as fa, n - 6 * (5 - i) - 1 as fb, n - 6 * (5 - i) as fc, n - 6 * (4 - i) as fd from p, range(5) r(i)"
_SLIDING = "select i as fold_id, n - 6 * (5 - i) - 19 as fa, n - 6 * (5 - i) - 1 as fb, n - 6 * (5 - i) as fc, n - 6 * (4 - i) as fd from p, range(5) r(i)"
_ROLLING = "select i as fold_id, 0 as fa, 6 * i + 6 as fb, 6 * i + 7 as fc, 6 * i + 13 as fd from range(5) r(i)"
# 4 folds, the first fifth of the periods before them, 2 left out
_PURGED = "select i as fold_id, 0 as fa, n // 5 + i * ((n - n // 5) // 4) - 2 as fb, n // 5 + i * ((n - n // 5) // 4) as fc, case when i = 3 then n else n // 5 + (i + 1) * ((n - n // 5) // 4) end as fd from p, range(4) r(i)"


def _periods(m) -> int:
    return m.agg(F.max("t")).first()[0] + 1


@query("folds_expanding", _spans_sql(_EXPANDING))
def _(t):
    m = monthly(t)
    return folds.fold_sizes(folds.assign(m, "t", folds.expanding(_periods(m), 5, 6, 1)), "t")


@query("folds_sliding", _spans_sql(_SLIDING))
def _(t):
    m = monthly(t)
    return folds.fold_sizes(folds.assign(m, "t", folds.expanding(_periods(m), 5, 6, 1, 18)), "t")


@query("folds_rolling_origin", _spans_sql(_ROLLING))
def _(t):
    m = monthly(t)
    return folds.fold_sizes(folds.assign(m, "t", folds.rolling_origin(_periods(m), 5, 6, 1)), "t")


@query("folds_purged_embargo", _spans_sql(_PURGED))
def _(t):
    m = monthly(t)
    return folds.fold_sizes(folds.assign(m, "t", folds.purged(_periods(m), 4)), "t")


@query("fold_invariants", "select fold_id, train_max + 1 < valid_min as ordered, n_train, n_valid from (" + _spans_sql(_EXPANDING) + ")")
def _(t):
    m = monthly(t)
    return folds.invariants(folds.assign(m, "t", folds.expanding(_periods(m), 5, 6, 1)), "t", 1)


@query("folds_stored", _spans_sql(_EXPANDING))
def _(t):
    m = monthly(t)
    return folds.fold_sizes(folds.stored(folds.assign(m, "t", folds.expanding(_periods(m), 5, 6, 1))), "t")


@query("holdout_split", f"with {MONTHLY_SQL}, p as (select max(t) + 1 as n from monthly) select t >= floor(0.8 * n) as valid, count(*) as n, min(t) as first, max(t) as last from monthly, p group by 1")
def _(t):
    m = monthly(t)
    return m.groupBy((F.col("t") >= folds.holdout_cut(_periods(m))).alias("valid")).agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("mean_group_length", "select round(avg(n), 4) as mean_length, greatest(1, floor(avg(n) / 6))::int as valid_size from (select o_orderpriority, count(*) as n from orders group by 1)")
def _(t):
    return rounded(folds.mean_length(t("orders"), ["o_orderpriority"]))


_METRICS = f"{PRED_SQL}, m as (select fold_id, count(*) as n, avg(abs(y - p)) as mae, sqrt(avg((y - p) * (y - p))) as rmse, avg(p) as pred_mean, stddev_samp(p) as pred_std from pred group by 1)"


@query("oof_fold_metrics", f"with {_METRICS} select fold_id, n, round(mae, 4) as mae, round(rmse, 4) as rmse, round(pred_mean, 4) as pred_mean, round(pred_std, 4) as pred_std from m")
def _(t):
    return rounded(folds.oof_metrics(predicted(t), "y", "p"))


@query("oof_summary", f"with {_METRICS} select count(*) as n_folds, round(avg(mae), 4) as mae_mean, round(stddev_pop(mae), 4) as mae_std, round(min(mae), 4) as mae_min, round(max(mae), 4) as mae_max, case when stddev_pop(mae) > 0.5 * avg(mae) then 'UNSTABLE' else 'OK' end as verdict from m")
def _(t):
    return rounded(folds.oof_summary(folds.oof_metrics(predicted(t), "y", "p"), 5))


_NULLS = "c as (select c_custkey, c_mktsegment, c_nationkey, case when c_custkey % 7 = 0 then null else c_acctbal end as b from customer)"


def _nulls(t):
    return t("customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("b"))


@query("median_impute", f"with {_NULLS} select c_custkey, round(coalesce(b, (select median(b) from c where c_custkey % 2 = 0)), 4) as b from c")
def _(t):
    c = _nulls(t)
    return rounded(encode.impute(c.select("c_custkey", "b"), encode.fit_fill(c.where("c_custkey % 2 = 0"), ["b"]), ["b"]))


@query("standard_scale", f"with {_NULLS} select c_custkey, round((b - (select avg(b) from c where c_custkey % 2 = 0)) / (select coalesce(nullif(stddev_samp(b), 0), 1) from c where c_custkey % 2 = 0), 4) + 0.0 as b from c")
def _(t):
    c = _nulls(t)
    return rounded(encode.scale(c.select("c_custkey", "b"), encode.fit_scale(c.where("c_custkey % 2 = 0"), ["b"]), ["b"]))


@query("target_encode_full", f"with {_NULLS}, tr as (select * from c where c_custkey % 3 <> 0), s as (select c_mktsegment, count(b) as n, sum(b) as s from tr where c_mktsegment <> 'AUTOMOBILE' group by 1), m as (select avg(b) as mu from tr where c_mktsegment <> 'AUTOMOBILE') select c_custkey, round((coalesce(s, 0) + 10 * mu) / (coalesce(n, 0) + 10), 4) as c_mktsegment_te from c left join s using (c_mktsegment), m")
def _(t):
    c = _nulls(t)
    return rounded(encode.target_encode(c.where("c_custkey % 3 <> 0 and c_mktsegment <> 'AUTOMOBILE'"), c, "c_mktsegment", "b").select("c_custkey", "c_mktsegment_te"))


_FOLDED = f"{_NULLS}, f as (select *, {_hash('c_custkey', 5)} as fold_id from c)"


@query("target_encode_oof", f"with {_FOLDED}, m as (select avg(b) as mu from f) select a.c_custkey, round((select case when count(o.b) > 0 then (sum(o.b) + 10 * mu) / (count(o.b) + 10) else mu end from f o, m where o.c_mktsegment = a.c_mktsegment and o.fold_id <> a.fold_id group by mu), 4) as c_mktsegment_te from f a")
def _(t):
    c = _nulls(t).withColumn("fold_id", hash_fold("c_custkey", 5))
    return rounded(encode.target_encode_oof(c, "c_mktsegment", "b").select("c_custkey", "c_mktsegment_te"))


_REL = "r as (select *, dense_rank() over (partition by f order by m desc) as rk, row_number() over (partition by f order by m desc, g) as k, sum(m) over (partition by f) as sm, count(*) over (partition by f) as n from means), e as (select f, g, m, rk, coalesce((sm - m) / nullif(n - 1, 0), m) as peer, m - avg(case when k <= 3 then m end) over (partition by f) as gap from r)"


@query("relational_full", f"with {_NULLS}, means as (select 0 as f, c_nationkey as g, avg(b) as m from c group by 2), {_REL} select c_custkey, round(rk, 4)::double as group_rank, round(peer, 4) + 0.0 as peer_mean, round(gap, 4) + 0.0 as gap_to_top from c join e on g = c_nationkey")
def _(t):
    c = _nulls(t)
    return rounded(encode.relational_encode(c, c, "c_nationkey", "b").select("c_custkey", "group_rank", "peer_mean", "gap_to_top"))


@query("relational_oof", f"with {_FOLDED}, means as (select x.f, c_nationkey as g, avg(b) as m from f, (select distinct fold_id as f from f) x where fold_id <> x.f group by 1, 2 having count(b) > 0), {_REL}, av as (select f, avg(rk) as r0, avg(m) as m0 from e group by 1) select c_custkey, round(coalesce(rk, r0), 4)::double as group_rank, round(coalesce(peer, m0), 4) + 0.0 as peer_mean, round(coalesce(gap, 0), 4) + 0.0 as gap_to_top from f a join av on av.f = a.fold_id left join e on e.g = a.c_nationkey and e.f = a.fold_id")
def _(t):
    c = _nulls(t).withColumn("fold_id", hash_fold("c_custkey", 5))
    return rounded(encode.relational_encode_oof(c, "c_nationkey", "b", 5).select("c_custkey", "group_rank", "peer_mean", "gap_to_top"))


@query("relational_qualifies", f"with {_NULLS}, means as (select c_nationkey as g, avg(b) as m from c group by 1), s as (select avg(m) as mu from means) select count(*) as n_groups, round(avg(pow(m - mu, 3)) / pow(avg(pow(m - mu, 2)), 1.5), 4) + 0.0 as skewness, count(*) >= 20 and avg(pow(m - mu, 3)) / pow(avg(pow(m - mu, 2)), 1.5) >= 1 as qualifies from means, s")
def _(t):
    return rounded(encode.qualifies(_nulls(t), "c_nationkey", "b"))
