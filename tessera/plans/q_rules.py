"""Rules over small metrics: the metrics are aggregates of the tables, the rules the operators' own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import assemble, audit, axis, folds, roles, shift, submit
from tessera.plans.panels import DAILY_SQL, MONTHLY_SQL, PRED_SQL, daily, monthly, predicted, rounded
from tessera.plans.registry import query


def _rows(t, rows, schema):
    return t("region").sparkSession.createDataFrame(rows, schema)


_ERROR_SQL = f"{PRED_SQL}, e as (select avg(abs(y - p)) as mae, stddev_samp(y) as sigma, avg(abs(y - p)) filter (fold_id = 4) as late from pred)"


def _errors(t):
    e = F.abs(F.col("y") - F.col("p"))
    return predicted(t).agg(F.avg(e).alias("mae"), F.stddev_samp("y").alias("sigma"), F.avg(F.when(F.col("fold_id") == 4, e)).alias("late")).first()


_SCALES = (1.0, 0.04, 0.005)


@query("cv_too_good", f"with {_ERROR_SQL} select scale::double as scale, case when mae * scale / sigma < 0.01 then 'CV_INVALID' when mae * scale / sigma < 0.05 then 'CV_RISK' else 'CV_OK' end as verdict from e, (select unnest({list(_SCALES)}) as scale)")
def _(t):
    """An error as it is, and as it would look with a leak."""
    e = _errors(t)
    return _rows(t, [(s, audit.too_good(e.mae * s, e.sigma)) for s in _SCALES], "scale double, verdict string")


@query("error_plausibility", f"with {_ERROR_SQL} select scale::double as scale, validator, case when mae * scale < 0.03 * sigma and validator <> 'PASS' then 'CRITICAL' when mae * scale > 0.8 * sigma then 'WARNING' else 'PASS' end as verdict from e, (select unnest([2.0, 1.0, 0.01]) as scale), (select unnest(['PASS', 'WARNING']) as validator)")
def _(t):
    e = _errors(t)
    return _rows(t, [(s, v, audit.plausibility(e.mae * s, e.sigma, v)) for s in (2.0, 1.0, 0.01) for v in ("PASS", "WARNING")], "scale double, validator string, verdict string")


_GAP_SQL = "case when (late - mae) / mae > 0.25 then 'CRITICAL' when (late - mae) / mae > 0.10 then 'WARNING' else 'PASS' end"


@query(
    "retune_decision",
    f"with {_ERROR_SQL}, v as (select cause, cycle, case when ({_GAP_SQL}) = 'CRITICAL' and cause = 'CV_SCHEME' then 'WARNING' else {_GAP_SQL} end as checked from e, (select unnest(['CV_SCHEME', 'REAL_DIVERGENCE']) as cause), (select unnest([1, 2]) as cycle)) select cause, cycle::int as cycle, checked, case when cycle >= 2 then 'accept' when checked = 'CRITICAL' then 'retune' else 'accept' end as decision from v",
)
def _(t):
    """The latest fold against all: its gap's verdict, what the cause makes of it, and what is decided in either cycle."""
    e = _errors(t)
    verdict = audit.gap_verdict(_rows(t, [(e.mae, e.late)], "reported_mae double, strict_mae double")).first()["verdict"]
    out = [(cause, cycle, c := audit.concordance(verdict, cause), audit.decide([c], False, cycle)) for cause in ("CV_SCHEME", "REAL_DIVERGENCE") for cycle in (1, 2)]
    return _rows(t, out, "cause string, cycle int, checked string, decision string")


@query("validator_checks", f"with {PRED_SQL}, a as (select avg(abs(y - p)) as mae from pred), s as (select g, sum(abs(y - p)) as w from pred group by 1), f as (select fold_id, (avg(abs(y - p)) - any_value(mae)) / any_value(mae) as gap, (select max(w) / sum(w) from s) as max_share, fold_id = 3 as has_suspect from pred, a group by 1) select fold_id, round(gap, 4) + 0.0 as gap, round(max_share, 4) as max_share, case when gap > 0.25 then 'CRITICAL' when gap > 0.1 then 'WARNING' else 'PASS' end as cv_integrity, case when max_share > 0.5 then 'WARNING' else 'PASS' end as importance_concentration, case when has_suspect then 'CRITICAL' else 'PASS' end as leakage_two_signal, case when gap > 0.25 or has_suspect then 'CRITICAL' when gap > 0.1 or max_share > 0.5 then 'WARNING' else 'PASS' end as verdict from f")
def _(t):
    """Each fold's error against all; a supplier's share of all error stands for a feature's importance."""
    p = predicted(t).withColumn("e", F.abs(F.col("y") - F.col("p")))
    top = p.groupBy("g").agg(F.sum("e").alias("w")).agg((F.max("w") / F.sum("w")).alias("max_share"))
    mae = p.agg(F.avg("e").alias("mae"))
    by_fold = p.groupBy("fold_id").agg(F.avg("e").alias("strict")).crossJoin(F.broadcast(mae)).crossJoin(F.broadcast(top))
    facts = by_fold.select("fold_id", ((F.col("strict") - F.col("mae")) / F.col("mae")).alias("gap"), "max_share", (F.col("fold_id") == 3).alias("has_suspect"))
    return rounded(audit.validator_verdict(facts).drop("has_suspect"))


_NAMES_SQL = "n as (select unnest([lower(event_type) || '_lag_1', lower(event_type) || '_lead_2', 'future_' || lower(event_type), lower(event_type) || '_t+1', 'value_' || lower(event_type), 'value_roll_' || lower(event_type)]) as name from (select distinct event_type from events))"


@query("structural_leak_names", f"with {_NAMES_SQL} select name, case when regexp_matches(name, '_lead[_0-9]|(_|^)future|_t[+][0-9]+') then 'names the future' else 'holds the target''s name' end as why from n where regexp_matches(name, '_lead[_0-9]|(_|^)future|_t[+][0-9]+') or name like 'value_%' and not regexp_matches(name, '_lag_?[0-9]+|_roll|_mean|_std|_min|_max|_enc')")
def _(t):
    """Names of features that would be made of the events' types, with the target ``value``."""
    e = F.lower("event_type")
    names = [F.concat(e, F.lit("_lag_1")), F.concat(e, F.lit("_lead_2")), F.concat(F.lit("future_"), e), F.concat(e, F.lit("_t+1")), F.concat(F.lit("value_"), e), F.concat(F.lit("value_roll_"), e)]
    found = [r[0] for r in t("events").select("event_type").distinct().select(F.explode(F.array(*names))).collect()]
    return _rows(t, shift.structural_leaks(sorted(found), "value"), "name string, why string")


@query("leakage_risk_list", f"with {MONTHLY_SQL}, m as (select max(t) as top from monthly), r as (select 'val has periods inside train' as risk where exists (select 1 from monthly a, monthly b, m where a.t >= top - 6 and b.t < top - 3 and a.t = b.t) union all select 'groups are in train and val' where exists (select 1 from monthly a, monthly b, m where a.t >= top - 6 and b.t < top - 3 and a.g = b.g) union all select 'supplier_id is named as an id') select risk from r")
def _(t):
    m = monthly(t)
    top = m.agg(F.max("t")).first()[0]
    train, val = m.where(F.col("t") < top - 3), m.where(F.col("t") >= top - 6)
    inside = not val.select("t").distinct().join(train.select("t").distinct(), "t", "left_semi").isEmpty()
    overlap = not val.select("g").distinct().join(train.select("g").distinct(), "g", "left_semi").isEmpty()
    return _rows(t, [(r,) for r in shift.leakage_risks(["supplier_id", "d", "x"], "y", inside, overlap)], "risk string")


@query("cv_plan", f"with {MONTHLY_SQL}, p as (select count(distinct t) as n from monthly) select problem, case when problem = 'panel_forecasting' then case when sliding then 'sliding' else 'expanding' end when problem = 'tabular_classification' then 'stratified' else 'kfold' end as scheme, greatest(1, least(6, case when n // 6 = 0 then 1 else n // 6 end))::int as valid_size, 1 as gap from p, (select unnest(['panel_forecasting', 'tabular_regression', 'tabular_classification']) as problem), (select unnest([true, false]) as sliding)")
def _(t):
    """The plan for six periods to forecast, the first two steps ahead."""
    n = monthly(t).select("t").distinct().count()
    plans = [(p, folds.plan(p, n, 6, 2, sliding)) for p in ("panel_forecasting", "tabular_regression", "tabular_classification") for sliding in (True, False)]
    return _rows(t, [(p, x["scheme"], x["valid_size"], x["gap"]) for p, x in plans], "problem string, scheme string, valid_size int, gap int")


_KINDS = (("labels", "toxic", "n = 2", "binary"), ("customer", "c_mktsegment", "n = 2", "multiclass"), ("lineitem", "l_tax", "n > 0", "continuous_regression"), ("lineitem", "l_linenumber", "n > 0", "ordinal_regression"), ("part", "p_retailprice", "n > 0", "continuous_regression"))


@query("problem_types", " union all ".join(
    f"select '{c}' as target, case when count(distinct {c}) = 2 then 'binary' when '{kind}' = 'multiclass' then 'multiclass' when count(distinct {c}) > 50 or count(*) filter (try_cast({c} as double) <> floor(try_cast({c} as double))) > 0 then 'continuous_regression' else 'ordinal_regression' end as subtype, case when count(distinct {c}) = 2 or '{kind}' = 'multiclass' then 'tabular_classification' else 'tabular_regression' end as kind from {table}"
    for table, c, _, kind in _KINDS))
def _(t):
    found = [(c, roles.classify(t(table), c, None, [])) for table, c, _, _ in _KINDS]
    return _rows(t, [(c, p.subtype, p.kind) for c, p in found], "target string, subtype string, kind string")


@query("numeric_or_kept_columns", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag from lineitem")
def _(t):
    return assemble.numeric_only(t("lineitem"), ("l_returnflag",))


@query("output_problems", "with s as (select user_id, case when sum(value) > 0 and user_id % 7 = 0 then null when user_id % 11 = 0 then -1.0 else sum(value) end as y from events group by 1), n as (select count(*) filter (y is null) as n_null, count(*) filter (y < 0) as n_negative, count(*) as n from s) select n_null || ' n_null' as problem from n where n_null > 0 union all select n_negative || ' n_negative' from n where n_negative > 0 union all select n || ' rows for ' || (n - 1) from n")
def _(t):
    e = t("events").groupBy("user_id").agg(F.sum("value").alias("s"))
    s = e.select("user_id", F.when((F.col("s") > 0) & (F.col("user_id") % 7 == 0), None).when(F.col("user_id") % 11 == 0, -1.0).otherwise(F.col("s")).alias("y"))
    first = s.agg(F.min("user_id")).first()[0]
    return _rows(t, [(p,) for p in submit.check_output(s, s.where(F.col("user_id") != first), "y")], "problem string")


@query("holdout_sequential", "with n as (select part.*, row_number() over (order by p_retailprice, p_partkey) - 1 as i, floor(0.8 * count(*) over ()) as cut from part) select p_partkey, case when i < cut then 'train' else 'valid' end as role from n")
def _(t):
    """Rows without groups or time: the first 80 % by the given order."""
    rows, scheme = folds.strict(t("part"), ["region", "store"], ["p_retailprice", "p_partkey"])
    assert scheme == "80/20 sequential"
    return rows.select("p_partkey", "role")


@query("codebook_ranks", f"with {DAILY_SQL}, d as (select distinct day, day(day) <> 7 as known, dense_rank() over (order by day) as r from daily), b as (select md5(day::varchar) as id, day from d where known), p as (select md5(day::varchar) as id, r <= 24 as in_train, r > 20 as in_val from d) select p.id, b.day as date, case when b.day is not null then (row_number() over (order by b.day nulls last) - 1)::bigint end as period_rank, in_train, in_val from p left join b using (id)")
def _(t):
    """Opaque ids of days, of which the codebook lacks one."""
    d = daily(t).select("day").distinct()
    ranks = axis.period_rank(d, d, "day")
    d = d.join(ranks, "day").select(F.md5(F.col("day").cast("string")).alias("id"), "day", "period_rank")
    book = d.where(F.dayofmonth("day") != 7).select(F.col("id").alias("period_id"), F.col("day").alias("date"))
    return axis.codebook_ranks(d.where("period_rank < 24").select("id"), d.where("period_rank >= 20").select("id"), book, "id")
