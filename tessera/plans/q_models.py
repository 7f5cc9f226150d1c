"""Models. What SQL can compute of them, sums, closed forms and recursions, is compared; trees are checked by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import adversarial, budget, features, fold_fit, folds, metrics, model, recursion, ridge, tuning
from tessera.plans.panels import DAILY_T_SQL, MONTHLY_SQL, daily_ranked, half_away, monthly, rounded
from tessera.plans.registry import query

ROUNDS = 5  # boosting rounds of the queries with a dozen fits and more; the operators' own default is 20
_F = ["lag_1", "lag_2", "roll_mean_4"]


def _panel(t):
    p = daily_ranked(t)
    g = ["event_type"]
    return p.select("event_type", "t", "y", *features.lags("y", g, "t", [1, 2]), features.rolls("y", g, "t", [4])[0]).where("lag_2 is not null")


def _periods(p) -> int:
    return p.agg(F.max("t")).first()[0] + 1


def _last(p, share: float):
    """(rows before the last share of periods, those from there on)."""
    cut = folds.holdout_cut(_periods(p), share)
    return p.where(F.col("t") < cut), p.where(F.col("t") >= cut)


@query("gbt_fit_predict")
def _(t):
    early, late = _last(_panel(t), 0.8)
    out = model.fit_predict(early, late, ["event_type", *_F], model.gbt("y"), ["event_type"])
    return rounded(out.select("event_type", "t", "y", "prediction"))


def _folded(t):
    p = _panel(t)
    return folds.assign(p, "t", folds.expanding(_periods(p), 5, 4, 1))


@query("nested_cv_oof")
def _(t):
    oof = model.cv_oof(_folded(t), ["event_type", "t"], "y", _F, model.SEEDS, rounds=ROUNDS)
    out = metrics.seed_ensemble(oof, ["event_type", "t", "fold_id", "y"], "prediction")
    return rounded(out)


# Rows of the daily panel with lags 1 and 2 and the mean of the four values before, in the folds of _folded().
_FOLDED_SQL = (
    f"{DAILY_T_SQL}, x as (select * from (select event_type, t, y, lag(y, 1) over w as x1, lag(y, 2) over w as x2, avg(y) over (w rows between 4 preceding and 1 preceding) as x3 from panel window w as (partition by event_type order by t)) where x2 is not null), "
    "e as (select max(t) + 1 as n from x), sp as (select i as fold_id, n - 4 * (5 - i) - 1 as fb, n - 4 * (5 - i) as fc, n - 4 * (4 - i) as fd from e, range(5) r(i)), "
    "tr as (select x.*, fold_id from x, sp where t < fb), va as (select x.*, fold_id from x, sp where t >= fc and t < fd)"
)
# The normal equations of three centred features, solved by determinants.
_RIDGE_SQL = (
    "m as (select fold_id, avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, avg(y) as my from tr group by 1), "
    "c as (select fold_id, any_value(m1) as m1, any_value(m2) as m2, any_value(m3) as m3, any_value(my) as my, sum((x1 - m1) * (x1 - m1)) as s11, sum((x2 - m2) * (x2 - m2)) as s22, sum((x3 - m3) * (x3 - m3)) as s33, "
    "sum((x1 - m1) * (x2 - m2)) as s12, sum((x1 - m1) * (x3 - m3)) as s13, sum((x2 - m2) * (x3 - m3)) as s23, sum((x1 - m1) * (y - my)) as b1, sum((x2 - m2) * (y - my)) as b2, sum((x3 - m3) * (y - my)) as b3 from tr join m using (fold_id) group by 1), "
    "k as (select c.*, alpha, s11 + alpha as d1, s22 + alpha as d2, s33 + alpha as d3 from c, (select unnest([0.01, 0.1, 1.0, 10.0, 100.0])::double as alpha)), "
    "d as (select *, d1 * (d2 * d3 - s23 * s23) - s12 * (s12 * d3 - s23 * s13) + s13 * (s12 * s23 - d2 * s13) as det from k), "
    "w as (select *, (b1 * (d2 * d3 - s23 * s23) - s12 * (b2 * d3 - s23 * b3) + s13 * (b2 * s23 - d2 * b3)) / det as w1, (d1 * (b2 * d3 - s23 * b3) - b1 * (s12 * d3 - s23 * s13) + s13 * (s12 * b3 - b2 * s13)) / det as w2, "
    "(d1 * (d2 * b3 - b2 * s23) - s12 * (s12 * b3 - b2 * s13) + b1 * (s12 * s23 - d2 * s13)) / det as w3 from d), "
    "f as (select fold_id::int as fold_id, alpha, my - m1 * w1 - m2 * w2 - m3 * w3 as intercept, w1, w2, w3 from w)"
)


@query("ridge_alpha_probe", f"with {_FOLDED_SQL}, {_RIDGE_SQL} select alpha, round(avg(abs(y - intercept - w1 * x1 - w2 * x2 - w3 * x3)), 4) as mae, count(*) as n from va join f using (fold_id) group by 1")
def _(t):
    return rounded(ridge.probe(_folded(t), "y", _F))


@query("ridge_coefficients", f"with {_FOLDED_SQL}, {_RIDGE_SQL} select fold_id, alpha, round(intercept, 4) as intercept, round(w1, 4) + 0.0 as lag_1, round(w2, 4) + 0.0 as lag_2, round(w3, 4) + 0.0 as roll_mean_4 from f")
def _(t):
    w = ridge.coefficients(_folded(t), "y", _F)
    return rounded(w.select("fold_id", "alpha", "intercept", *(F.col("w")[i].alias(c) for i, c in enumerate(_F))))


_PARTED_SQL = "q as (select l_orderkey % 5 as own, l_extendedprice as y, l_quantity as x1, l_discount as x2, l_tax as x3 from lineitem), tr as (select q.*, i::int as fold_id from q, range(5) r(i) where own <> i)"


@query("ridge_parted_folds", f"with {_PARTED_SQL}, {_RIDGE_SQL} select alpha, round(avg(abs(y - intercept - w1 * x1 - w2 * x2 - w3 * x3)), 2) as mae, count(*) as n from q join f on own = f.fold_id group by 1")
def _(t):
    """Folds that part the rows: a fold's training sums are all sums less its own."""
    q = t("lineitem").select((F.col("l_orderkey") % 5).cast("int").alias("fold_id"), F.col("l_extendedprice").alias("y"), "l_quantity", "l_discount", "l_tax")
    return rounded(ridge.probe(q, "y", ["l_quantity", "l_discount", "l_tax"], parted=True), 2)


@query("ridge_terms", f"with {_FOLDED_SQL.replace('tr as (select x.*, fold_id from x, sp where t < fb)', 'tr as (select x.*, 0 as fold_id from x)')}, {_RIDGE_SQL}, u as (select unnest(['lag_1', 'lag_2', 'roll_mean_4']) as feature, unnest([w1, w2, w3]) as c from f where alpha = 1.0) select row_number() over (order by abs(c) desc, feature)::int as rank, feature, round(c, 4) as coefficient from u")
def _(t):
    return rounded(ridge.terms(_panel(t), "y", _F, 1.0))


_ENCODED_SQL = (
    "p as (select p_partkey, p_brand, p_type, p_retailprice as y, case when p_partkey % 7 = 0 then null else p_size::double end as z, {own} as own, {inner} as inn from part), "
    "r as (select p.*, i::int as fold_id, case when own = i then 'valid' else 'train' end as role from p, range(5) r(i)), "
    "a as (select * from r where role = 'train'), md as (select fold_id, median(z) as md from a group by 1), mu as (select fold_id, avg(y) as mu from a group by 1), "
    "b1 as (select fold_id, p_brand as c, inn, count(y) as n, sum(y) as s from a group by 1, 2, 3), t1 as (select fold_id, c, sum(n) as n, sum(s) as s from b1 group by 1, 2), "
    "b2 as (select fold_id, p_type as c, inn, count(y) as n, sum(y) as s from a group by 1, 2, 3), t2 as (select fold_id, c, sum(n) as n, sum(s) as s from b2 group by 1, 2), "
    "j as (select r.p_partkey, r.fold_id, r.role, coalesce(z, md) as p_size, (coalesce(t1.s, 0) - case when role = 'train' then b1.s else 0 end + 10 * mu) / (coalesce(t1.n, 0) - case when role = 'train' then b1.n else 0 end + 10) as e1, "
    "(coalesce(t2.s, 0) - case when role = 'train' then b2.s else 0 end + 10 * mu) / (coalesce(t2.n, 0) - case when role = 'train' then b2.n else 0 end + 10) as e2 from r join md using (fold_id) join mu using (fold_id) "
    "left join t1 on t1.fold_id = r.fold_id and t1.c = p_brand left join b1 on b1.fold_id = r.fold_id and b1.c = p_brand and b1.inn = r.inn left join t2 on t2.fold_id = r.fold_id and t2.c = p_type left join b2 on b2.fold_id = r.fold_id and b2.c = p_type and b2.inn = r.inn), "
    "sc as (select fold_id, avg(p_size) as a0, stddev_samp(p_size) as d0, avg(e1) as a1, stddev_samp(e1) as d1, avg(e2) as a2, stddev_samp(e2) as d2 from j where role = 'train' group by 1), "
    "z as (select p_partkey, fold_id, role, (p_size - a0) / d0 as p_size, (e1 - a1) / d1 as p_brand_te, (e2 - a2) / d2 as p_type_te from j join sc using (fold_id))"
).format(**{n: f"(('0x' || substr(md5(p_partkey::varchar || '|{seed}'), 1, 8))::bigint % 5)::int" for n, seed in (("own", 42), ("inner", 7))})
_STEPS = [{"name": "impute_missing", "targets": ["p_size"]}, {"name": "target_encode", "targets": ["p_brand", "p_type"]}, {"name": "scale_features", "targets": ["p_size"]}]


def _encoded(t):
    p = t("part").select("p_partkey", "p_brand", "p_type", F.col("p_retailprice").alias("y"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("p_size"))
    assigned = folds.crossed(folds.kfold(p, "p_partkey", 5), 5)
    built = fold_fit.build(_STEPS, "y", ["p_partkey"], "linear")
    return fold_fit.fitted(assigned, built.stages)


@query("oof_encoded_pipeline", f"with {_ENCODED_SQL} select p_partkey, fold_id, role, round(p_size, 4) + 0.0 as p_size, round(p_brand_te, 4) + 0.0 as p_brand_te, round(p_type_te, 4) + 0.0 as p_type_te from z")
def _(t):
    """Imputer, target encoder and scaler refitted in each of five folds."""
    return rounded(_encoded(t).select("p_partkey", "fold_id", "role", "p_size", "p_brand_te", "p_type_te"))


@query("oof_encoded_ridge", f"with {_ENCODED_SQL}, x as (select z.*, y, p_size as x1, p_brand_te as x2, p_type_te as x3 from z join p using (p_partkey)), tr as (select * from x where role = 'train'), {_RIDGE_SQL} select alpha, round(avg(abs(y - intercept - w1 * x1 - w2 * x2 - w3 * x3)), 3) as mae, count(*) as n from x join f using (fold_id) where role = 'valid' group by 1")
def _(t):
    """A linear model behind the pipeline of each fold."""
    return rounded(ridge.probe(_encoded(t), "y", ["p_size", "p_brand_te", "p_type_te"]), 3)


@query("oof_boosted_pipeline")
def _(t):
    """Boosted trees behind an imputer that is refitted in each fold, with categories as they are."""
    p = t("part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("y"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("p_size"))
    built = fold_fit.build(_STEPS[:1] + [{"name": "target_encode", "targets": ["p_brand"]}], "y", ["p_partkey"])
    out = model.cv_oof(folds.crossed(folds.kfold(p, "p_partkey", 3), 3), ["p_partkey"], "y", ["p_size", *built.categorical], stages=built.stages, categorical=built.categorical, rounds=ROUNDS)
    return rounded(out)


def _early_late(t):
    """Orders before and from the first day of the last fifth of the days."""
    o = t("orders").select("o_orderkey", "o_totalprice", F.month("o_orderdate").cast("double").alias("m"), F.col("o_custkey").cast("double").alias("c"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("d"))
    cut = folds.holdout_cut(o.agg(F.max("d")).first()[0] + 1)
    return o.where(F.col("d") < cut), o.where(F.col("d") >= cut)


@query("adversarial_auc")
def _(t):
    """Gates, cross-fitted scores and their AUC of early against late orders."""
    early, late = _early_late(t)
    return rounded(adversarial.validate(early, late, "o_orderkey", ["o_totalprice", "m", "c"], rounds=ROUNDS).summary)


# Scores as a stand-in for a model's: the customer's number, higher for early orders.
_SCORES_SQL = (
    "o as (select o_orderkey, o_custkey, date_diff('day', date '1995-01-01', o_orderdate::date) as d from orders), e as (select floor(0.8 * (max(d) + 1)) as cut from o), "
    "s as (select o_orderkey, (d < cut)::int as is_train, (o_custkey % 89) / 89.0::double * 0.8 + case when d < cut then {lift} else 0 end as score from o, e), "
    "r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from s), "
    "g as (select sum(is_train)::bigint as n_train, sum(1 - is_train)::bigint as n_val, (sum(case when is_train = 1 then rk end) - sum(is_train) * (sum(is_train) + 1) / 2.0) / (sum(is_train) * sum(1 - is_train)) as auc from r), "
    "v as (select n_train, n_val, {columns}::int as n_columns, auc, case when n_train + n_val < 500 then 'few rows' when n_train < 100 then 'few training rows' when n_val < 100 then 'few rows to predict' when {columns} < 3 then 'few columns' when auc < 0.55 then 'no shift' end as skip_reason from g)"
)


def _stand_in(t, lift: float):
    early, late = (side.select("o_orderkey", F.lit(i).alias("is_train"), (F.col("c").cast("long") % 89 / 89.0 * 0.8 + lift * i).alias("score")) for i, side in zip((1, 0), _early_late(t), strict=True))
    return early.unionByName(late)


_VERDICTS = [(0.2, 3), (0.2, 2), (0.01, 3)]


@query("adversarial_gates", " union all ".join(f"select * from (with {_SCORES_SQL.format(lift=lift, columns=n)} select n_train, n_val, n_columns, round(auc, 4) as auc, skip_reason, skip_reason is null as applied from v)" for lift, n in _VERDICTS))
def _(t):
    """A shift, too few columns, and no shift."""
    one, two, three = (adversarial.judged(_stand_in(t, lift), n) for lift, n in _VERDICTS)
    return rounded(one.union(two).union(three))


@query("adversarial_weights", f"with {_SCORES_SQL.format(lift=0.2, columns=3)}, w as (select o_orderkey, least(greatest(1 - score, 0.1), 10) as w from s where is_train = 1) select o_orderkey, round(case when (select skip_reason from v) is null then w / (select avg(w) from w) else 1 end, 4) as weight from w")
def _(t):
    return rounded(adversarial.weights(_stand_in(t, 0.2), 3).select("o_orderkey", "weight"))


_W = "over (partition by g order by t)"


@query("budgeted_features", f"with {MONTHLY_SQL}, e as (select g, t, y, d, x, lag(y, 1) {_W} as lag_1, avg(y) over (partition by g order by t rows between 4 preceding and 1 preceding) as roll_mean_4, avg(d) over (partition by g order by t rows between 8 preceding and 1 preceding) as d_roll8, stddev_samp(x) over (partition by g order by t rows between 4 preceding and 1 preceding) as x_std4, d / (abs(x) + 1e-9) as ratio, d - avg(d) over (partition by g) as d_group_dev, greatest(d, 0) as pd, greatest(x, 0) as px from monthly) select g, t, round(lag_1, 4) as lag_1, round(roll_mean_4, 4) as roll_mean_4, round(d_roll8, 4) as d_roll8, round(x_std4, 4) as x_std4, round(ratio, 3) as ratio, round(d_group_dev, 4) + 0.0 as d_group_dev, round(case when pd + px > 0 then -(pd / (pd + px) * ln(pd / (pd + px) + 1e-9) + px / (pd + px) * ln(px / (pd + px) + 1e-9)) else -ln(0.5 + 1e-9) end, 4) + 0.0 as cov_entropy from e")
def _(t):
    """All families of a panel that the budget bears."""
    made, found = budget.panel_features(monthly(t), ["g"], "t", "y", ["d", "x"])
    assert not found.refused, found.refused
    return rounded(made.select("g", "t", "lag_1", "roll_mean_4", "d_roll8", F.col("x_std4"), half_away(F.col("d_per_x"), 3).alias("ratio"), "d_group_dev", "cov_entropy"))


@query("transform_probe")
def _(t):
    p = _panel(t).withColumn("scored", F.lit(True))
    return rounded(model.transform_probe(*_last(p, 0.8), ["event_type", "t"], "y", _F, "scored"))


@query("strict_cv")
def _(t):
    p = _panel(t)
    return rounded(model.strict_cv(p, "t", _periods(p), ["event_type", "t"], "y", _F))


@query("leave_one_out")
def _(t):
    p = _panel(t)
    return rounded(model.without_each(p, "t", _periods(p), ["event_type", "t"], "y", _F, rounds=ROUNDS))


@query("importance_by_model")
def _(t):
    found = model.shares(_panel(t), ["event_type", *_F], model.gbt("y"), ["event_type"])
    spark = t("region").sparkSession
    return rounded(spark.createDataFrame(sorted(found.items()), "feature string, share double"))


@query("recursive_forecast")
def _(t):
    """Trees that read their own predictions against trees that read the last known value, the better one of a holdout for each step."""
    p = daily_ranked(t).select("event_type", "t", "y")
    early, late = _last(p, 0.87)
    return rounded(model.recursive_forecast(early, late, ["event_type"], "t", "y", [1, 2], windows=[4]))


_CUT_SQL = f"{DAILY_T_SQL}, e as (select floor(0.87 * (max(t) + 1)) as cut from panel), early as (select panel.* from panel, e where t < cut), late as (select panel.* from panel, e where t >= cut), h as (select event_type, list(y order by t) as h from early group by 1)"


@query("recursion_rings", f"with {_CUT_SQL} select event_type, round(h[-1], 4) as lag_1, round(coalesce(h[-2], h[-1]), 4) as lag_2, round(list_avg(h[-4:]), 4) as roll_mean_4, round(coalesce(list_stddev_samp(h[-4:]), 0), 4) as roll_std_4 from h")
def _(t):
    early, _ = _last(daily_ranked(t), 0.87)
    r = recursion.rings(early, ["event_type"], "t", "y", 4)
    return rounded(r.select("event_type", *recursion.ring_features(F.col("ring"), [1, 2], [4])))


@query("last_known_features", f"with {_CUT_SQL} select event_type, t, round(h[-1], 4) as lag_1, round(h[-1], 4) as lag_2, round(h[-1], 4) as roll_mean_4, 0.0::double as roll_std_4 from late join h using (event_type)")
def _(t):
    early, late = _last(daily_ranked(t).select("event_type", "t", "y"), 0.87)
    return rounded(recursion.imputed(early, late.select("event_type", "t"), ["event_type"], "t", "y", [1, 2], [4]))


@query(
    "recursive_linear_forecast",
    f"with recursive {_CUT_SQL}, top as (select 10 * max(y) as top from early), v as (select event_type, t, row_number() over (partition by event_type order by t)::int as step from late), "
    "r as (select event_type, 0 as step, h[-2:] as h from h union all select event_type, step + 1, [h[-1], least(greatest(0.5 * h[-1] + 0.3 * h[-2] + 0.2 * (h[-1] + h[-2]) / 2 + 1, 0), (select top from top))] from r where step < (select max(step) from v)) "
    "select v.event_type, t, v.step, round(r.h[-1], 4) as recursive, round(least(greatest(h.h[-1] + 1, 0), (select top from top)), 4) as imputed from v join r on r.event_type = v.event_type and r.step = v.step join h on h.event_type = v.event_type",
)
def _(t):
    """A linear rule in place of a fitted model, so that SQL can follow the recursion."""
    early, late = _last(daily_ranked(t).select("event_type", "t", "y"), 0.87)
    rule = lambda rows: rows.withColumn("prediction", 0.5 * F.col("lag_1") + 0.3 * F.col("lag_2") + 0.2 * F.col("roll_mean_2") + 1)
    return rounded(recursion.forecast(early, late, ["event_type"], "t", "y", [1, 2], [2], rule))


@query("search_halving")
def _(t):
    """Settings of the first two of five folds, drawn, fitted side by side and halved."""
    p = _panel(t)
    assigned = folds.assign(p, "t", folds.expanding(_periods(p), 2, 4, 1))
    return rounded(tuning.search(assigned, "y", _F, trials=4, rounds=8, rungs=2).table(p.sparkSession))


@query("family_ablation")
def _(t):
    return rounded(model.ablation(_folded(t), ["event_type", "t"], "y", {"lags": ["lag_1", "lag_2"], "rolls": ["roll_mean_4"]}, ROUNDS))


@query("multiclass_forest")
def _(t):
    e = t("embeddings")
    names = [f"e{i}" for i in range(e.select(F.max(F.size("embedding"))).first()[0])]
    e = e.select("vec_id", F.col("label").cast("double").alias("label"), *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)))
    train = e.where("vec_id % 5 <> 0")
    out = model.fit_predict(train, e.where("vec_id % 5 = 0"), names, model.classifier(train, "label"))
    return out.select("vec_id", "label", "prediction")
