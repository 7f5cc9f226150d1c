"""Metrics, post-processing and verdicts, with the group's value before as the prediction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import audit, folds, metrics
from tessera.plans.panels import PRED_SQL, predicted, rounded
from tessera.plans.registry import query


@query("mae_scored_by_category", f"with {PRED_SQL} select g, count(*) as n, round(avg(abs(y - p)), 4) as mae, round(avg(abs(y - p)) filter (t % 2 = 0), 4) as mae_scored from pred group by g")
def _(t):
    return rounded(metrics.mae_by(predicted(t).withColumn("s", F.col("t") % 2 == 0), ["g"], "y", "p", "s"))


@query("mae_by_step", f"with {PRED_SQL} select t, count(*) as n, round(avg(abs(y - p)), 4) as mae, round(avg(abs(y - p)) filter (g % 2 = 0), 4) as mae_scored from pred group by t")
def _(t):
    return rounded(metrics.mae_by(predicted(t).withColumn("s", F.col("g") % 2 == 0), ["t"], "y", "p", "s"))


_SEEDS = f"{PRED_SQL}, seeds as (select g, t, p * (1 + s * 0.01) as p from pred, (values (0), (1), (3)) v(s))"


def _seeds(t):
    return predicted(t).select("g", "t", F.explode(F.array(*(F.col("p") * (1 + F.lit(s) * 0.01) for s in (0, 1, 3)))).alias("p"))


@query("seed_ensemble", f"with {_SEEDS} select g, t, round(avg(p), 4) as prediction, round(stddev_pop(p), 4) as disagreement from seeds group by 1, 2")
def _(t):
    return rounded(metrics.seed_ensemble(_seeds(t), ["g", "t"], "p"))


@query("seed_ensemble_median", f"with {_SEEDS} select g, t, round(median(p), 4) as prediction, round(stddev_pop(p), 4) as disagreement from seeds group by 1, 2")
def _(t):
    return rounded(metrics.seed_ensemble(_seeds(t), ["g", "t"], "p", "median"))


_W = f"{PRED_SQL}, w as (select *, 1 + (t % 3)::double as w from pred), a as (select sum(w * (y - p)) / sum(w) as al from w), b as (select g, count(*) as n, al + case when count(*) >= 30 then 0.5 * (sum(w * (y - p)) / sum(w) - al) else 0 end as bias from w, a group by g, al)"


def _weighted(t):
    return predicted(t).withColumn("w", 1 + (F.col("t") % 3).cast("double"))


@query("weighted_bias_shrunk", f"with {_W} select g, n, round(bias, 4) + 0.0 as bias from b")
def _(t):
    return rounded(metrics.level_correction(_weighted(t), "g", "y", "p", "w"))


@query("level_correction_gain", f"with {_W} select round(sum(abs(y - p) * w) / sum(w), 4) as before, round(sum(abs(y - p - bias) * w) / sum(w), 4) as after, sum(abs(y - p - bias) * w) / sum(w) < sum(abs(y - p) * w) / sum(w) * 0.985 as applied from w join b using (g)")
def _(t):
    w = _weighted(t)
    return rounded(metrics.apply_level(w, metrics.level_correction(w, "g", "y", "p", "w"), "g", "y", "p", "w"))


@query("weighted_mae", f"with {_W} select round(sum(abs(y - p) * w) / sum(w), 4) as wmae from w")
def _(t):
    return rounded(metrics.weighted_mae(_weighted(t), "y", "p", "w"))


_SCORES = "s as (select event_id, (value > 20)::int as y, (event_id * 37 % 101) / 101.0::double as s from events)"


def _scores(t):
    return t("events").select("event_id", (F.col("value") > 20).cast("int").alias("y"), (F.col("event_id") * 37 % 101 / 101.0).alias("s"))


_SWEEP = _SCORES + ", g as (select unnest(range(5, 96)) as cut), w as (select (cut / 100.0)::double as threshold, sum((y = 1 and floor(s * 100 + 1e-9) >= cut)::int)::bigint as tp, sum((y <> 1 and floor(s * 100 + 1e-9) >= cut)::int)::bigint as fp, sum((y = 1 and floor(s * 100 + 1e-9) < cut)::int)::bigint as fn from s, g group by cut), x as (select *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::double as f1 from w)"


@query("threshold_sweep_f1", f"with {_SWEEP} select round(threshold, 2) as threshold, tp, fp, fn, round(f1, 4) as f1 from x")
def _(t):
    return rounded(metrics.threshold_sweep(_scores(t), "y", "s")).withColumn("threshold", F.round("threshold", 2))


@query("threshold_best", f"with {_SWEEP}, b as (select arg_max(threshold, f1 - threshold * 1e-9) as best, max(f1) as best_f1, max(f1) filter (abs(threshold - 0.5) < 1e-9) as f1_half from x) select round(case when best_f1 - f1_half >= 0.02 then best else 0.5 end, 2) as threshold, round(best_f1, 4) as best_f1, round(f1_half, 4) as f1_half from b")
def _(t):
    return rounded(metrics.best_threshold(metrics.threshold_sweep(_scores(t), "y", "s")))


@query("roc_auc_ranks", f"with {_SCORES}, r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from s) select round((sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0)), 4)::double as auc from r")
def _(t):
    return rounded(metrics.roc_auc(_scores(t), "y", "s"))


@query("accuracy", f"with {_SCORES} select round(avg(((s >= 0.5)::int = y)::int), 4) as accuracy from s")
def _(t):
    return rounded(metrics.accuracy(_scores(t).withColumn("p", (F.col("s") >= 0.5).cast("int")), "y", "p"))


@query("class_weights", "select label, count(*) as n, round(sum(count(*)) over () / (count(*) over () * count(*)), 4)::double as weight from embeddings group by label")
def _(t):
    return rounded(metrics.class_weights(t("embeddings"), "label"))


@query("baseline_skill", f"with {PRED_SQL}, b as (select y, p, avg(y) over () as m from pred) select round(avg(abs(y - p)), 4) as mae, round(avg(abs(y - m)), 4) as baseline_mae, round(1 - avg(abs(y - p)) / avg(abs(y - m)), 4) + 0.0 as skill from b")
def _(t):
    p = predicted(t)
    return rounded(metrics.skill(p.crossJoin(F.broadcast(p.agg(F.avg("y").alias("m")))), "y", "p", "m"))


_FOLDS = f"{PRED_SQL}, f as (select fold_id, avg(abs(y - p)) as mae from pred group by 1)"


def _fold_mae(t):
    return folds.oof_metrics(predicted(t), "y", "p").select("fold_id", "mae")


@query("gap_verdict", f"with {_FOLDS}, g as (select fold_id, mae as strict_mae, (select avg(mae) from f) * (0.7 + 0.1 * fold_id) as reported_mae from f) select fold_id, round((strict_mae - reported_mae) / reported_mae, 4) + 0.0 as gap, case when (strict_mae - reported_mae) / reported_mae > 0.25 then 'CRITICAL' when (strict_mae - reported_mae) / reported_mae > 0.1 then 'WARNING' else 'PASS' end as verdict from g")
def _(t):
    f = _fold_mae(t)
    m = f.crossJoin(F.broadcast(f.agg(F.avg("mae").alias("m")))).select("fold_id", F.col("mae").alias("strict_mae"), (F.col("m") * (0.7 + 0.1 * F.col("fold_id"))).alias("reported_mae"))
    return rounded(audit.gap_verdict(m).select("fold_id", "gap", "verdict"))


@query("gap_attribution", f"with {PRED_SQL}, s as (select t // 16 as train_size, avg(abs(y - p)) as mae from pred group by 1), l as (select *, (mae < lag(mae) over (order by train_size))::int as fell from s), a as (select arg_max(mae, train_size) as latest_mae, avg(fell) as monotonicity, avg(mae) as mean_mae from l) select round(latest_mae, 4) as latest_mae, round(monotonicity, 4) as monotonicity, round(abs(latest_mae - 100) / 100, 4) as latest_off, round((mean_mae - latest_mae) / (mean_mae - 100), 4) + 0.0 as explained, case when abs(latest_mae - 100) / 100 <= 0.15 then 'CV_SCHEME' else 'REAL_DIVERGENCE' end as cause from a")
def _(t):
    s = predicted(t).groupBy(F.floor(F.col("t") / 16).alias("train_size")).agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return rounded(audit.gap_attribution(s, 100.0))


@query("ablation_decision", f"with {PRED_SQL}, d as (select 'f' || g % 3 as family, fold_id, avg(y - p) - (g % 3) * 20 as delta from pred group by g % 3, fold_id), a as (select family, avg(delta) as m, stddev_samp(delta) as s from d group by 1) select family, round(m, 4) + 0.0 as mean_delta, round(m / nullif(s, 0), 4) + 0.0 as effect, m < 0 and abs(m) > 2 and m / nullif(s, 0) < -2 * sqrt(ln(4)) as drop from a")
def _(t):
    d = predicted(t).groupBy(F.concat(F.lit("f"), F.col("g") % 3).alias("family"), "fold_id").agg((F.avg(F.col("y") - F.col("p")) - F.first(F.col("g") % 3) * 20).alias("delta"))
    return rounded(audit.ablation_decision(d, 100.0))


@query("fold_stability", f"with {_FOLDS} select round(stddev_pop(mae) / avg(mae), 4) as variation, round(max(mae), 4) as worst, round(median(mae), 4) as middle, case when stddev_pop(mae) / avg(mae) > 0.8 or max(mae) > 3 * median(mae) then 'CV_INVALID' when stddev_pop(mae) / avg(mae) > 0.4 then 'CV_RISK' else 'CV_OK' end as verdict from f")
def _(t):
    return rounded(audit.fold_stability(_fold_mae(t)))


@query("fold_outliers", f"with {_FOLDS} select fold_id, round(mae, 4) as mae, mae > avg(mae) over () + 1.5 * stddev_pop(mae) over () as outlier from f")
def _(t):
    return rounded(audit.fold_outliers(_fold_mae(t)))


@query("fold_drift", f"with {PRED_SQL} select fold_id, abs(avg(p) - avg(y)) > 0.3 * abs(avg(y)) or stddev_samp(p) < 0.4 * stddev_samp(y) as drifted from pred group by 1")
def _(t):
    return audit.fold_drift(predicted(t), "y", "p")


_IMP = "imp as (select fold_id, 'g' || g as feature, round(avg(y), 0) as importance from pred group by 1, 2)"


def _importance(t):
    return predicted(t).groupBy("fold_id", F.concat(F.lit("g"), F.col("g")).alias("feature")).agg(F.round(F.avg("y"), 0).alias("importance"))


_SPEAR = f"{PRED_SQL}, {_IMP}, j as (select a.fold_id as fold_a, b.fold_id as fold_b, a.importance as x, b.importance as y from imp a join imp b on a.feature = b.feature and a.fold_id < b.fold_id), r as (select fold_a, fold_b, rank() over (partition by fold_a, fold_b order by x) + (count(*) over (partition by fold_a, fold_b, x) - 1) / 2.0 as rx, rank() over (partition by fold_a, fold_b order by y) + (count(*) over (partition by fold_a, fold_b, y) - 1) / 2.0 as ry from j), s as (select fold_a, fold_b, corr(rx, ry) as spearman from r group by 1, 2)"


@query("spearman_importance", f"with {_SPEAR} select fold_a, fold_b, round(spearman, 4) + 0.0 as spearman from s")
def _(t):
    return rounded(audit.importance_stability(_importance(t)))


@query("importance_verdict", f"with {_SPEAR} select round(median(spearman), 4) + 0.0 as median_spearman, case when median(spearman) < 0.2 then 'CV_INVALID' when median(spearman) < 0.5 then 'CV_RISK' else 'CV_OK' end as verdict from s")
def _(t):
    return rounded(audit.importance_verdict(audit.importance_stability(_importance(t))))


@query("importance_shares", f"with {PRED_SQL}, {_IMP}, m as (select feature, avg(importance) as m from imp group by 1) select feature, round(m / sum(m) over (), 4) as share from m")
def _(t):
    return rounded(metrics.normalised_importance(_importance(t)))


@query("feature_concentration", f"with {PRED_SQL}, {_IMP}, m as (select feature, avg(importance) as m from imp group by 1), b as (select * from m order by m desc, feature limit 10) select feature, round(m / sum(m) over (), 4) as share, m / sum(m) over () > 0.5 as concentrated from b")
def _(t):
    return rounded(audit.concentration(_importance(t).groupBy("feature").agg(F.avg("importance").alias("importance"))))


@query("pred_distribution", f"with {PRED_SQL}, a as (select abs(avg(p) - avg(y)) / abs(avg(y)) as bias, stddev_samp(p) / stddev_samp(y) as spread from pred) select round(bias, 4) as bias, round(spread, 4) as spread, case when bias > 0.3 or spread < 0.4 then 'CRITICAL' when spread < 0.65 then 'WARNING' else 'PASS' end as verdict from a")
def _(t):
    return rounded(audit.prediction_distribution(predicted(t), predicted(t), "y", "p"))


@query("pred_sanity", f"with {PRED_SQL} select 0::bigint as n_null, count(*) filter (p - 50 < 0) as n_negative, round(max(p - 50), 4) as p_max, case when count(*) filter (p - 50 < 0) > 0 and min(y) >= 0 then 'CRITICAL' when max(p - 50) > 3 * max(y) or max(p - 50) < 0.4 * max(y) then 'WARNING' else 'PASS' end as verdict from pred")
def _(t):
    p = predicted(t)
    return rounded(audit.sanity(p.withColumn("p", F.col("p") - 50), p, "y", "p"))


@query("collapse_check", f"with {_SCORES} select count(distinct (s >= 0.999)::int) as n_labels, case when count(distinct (s >= 0.999)::int) = 1 then 'CRITICAL' else 'PASS' end as verdict from s")
def _(t):
    return audit.collapse(_scores(t).withColumn("p", (F.col("s") >= 0.999).cast("int")), "p")


@query("suspect_features", f"with {PRED_SQL}, m as (select 'g' || g as feature, avg(y - p) as loo_delta, g % 2 = 0 as structural from pred group by g) select feature, round(loo_delta, 4) + 0.0 as loo_delta, structural, structural and abs(loo_delta) < 5 as suspect from m")
def _(t):
    m = predicted(t).groupBy("g").agg(F.avg(F.col("y") - F.col("p")).alias("loo_delta")).select(F.concat(F.lit("g"), F.col("g")).alias("feature"), "loo_delta", (F.col("g") % 2 == 0).alias("structural"))
    return rounded(audit.suspects(m, 100.0))


@query("target_transforms", f"with {PRED_SQL} select g, t, round(sqrt(greatest(y, 0)), 4) as s, round(ln(1 + greatest(y, 0)), 4) as l, round(greatest(y, 0), 4) as back_s, round(greatest(y, 0), 4) as back_l from pred")
def _(t):
    (fs, bs), (fl, bl) = metrics.transforms("sqrt"), metrics.transforms("log1p")
    y = F.col("y")
    return rounded(predicted(t).select("g", "t", fs(y).alias("s"), fl(y).alias("l"), bs(fs(y)).alias("back_s"), bl(fl(y)).alias("back_l")))


@query("recursion_choice", f"with {PRED_SQL}, r as (select t, y, p, avg(y) over (partition by g order by t rows between 3 preceding and 1 preceding) as r from pred), e as (select * from r where r is not null), s as (select t, count(*) as n, avg(abs(y - r)) as a, avg(abs(y - p)) as b from e group by rollup (t)) select t, n, round(a, 4) as recursive_mae, round(b, 4) as last_known_mae, case when a <= b then 'recursive' else 'last_known' end as choice from s")
def _(t):
    r = predicted(t).withColumn("r", F.avg("y").over(Window.partitionBy("g").orderBy("t").rowsBetween(-3, -1))).where("r is not null")
    return rounded(metrics.recursion_choice(r, "t", "y", "r", "p"))


@query("transform_choice", f"with {PRED_SQL}, s as (select t % 2 = 0 as scored, y, p * f as p, name from pred, (values ('none', 1.0), ('sqrt', 0.97), ('log1p', 0.9)) v(name, f)), m as (select name as transform, avg(abs(y - p)) as mae from s where scored group by 1) select transform, round(mae, 4) as mae, transform = (select arg_min(transform, mae) from m) as chosen from m")
def _(t):
    names = F.array(*(F.struct(F.lit(n).alias("transform"), F.lit(f).alias("f")) for n, f in (("none", 1.0), ("sqrt", 0.97), ("log1p", 0.9))))
    s = predicted(t).select("t", "y", "p", F.inline(names)).select("transform", "y", (F.col("p") * F.col("f")).alias("p"), (F.col("t") % 2 == 0).alias("scored"))
    return rounded(metrics.transform_choice(s, "transform", "y", "p", "scored"))


@query("probability_ensemble", "with s as (select vec_id, s, k, ((vec_id * 31 + s * 17 + k * 7) % 101) / 101.0::double as p from embeddings, range(3) a(s), range(4) b(k)), m as (select vec_id, k, avg(p) as p from s group by 1, 2), b as (select vec_id, max(p) as top from m group by 1) select m.vec_id, min(k)::bigint as prediction, round(max(p), 4) as probability from m join b on m.vec_id = b.vec_id and abs(p - top) < 1e-12 group by 1")
def _(t):
    seeds, labels = (F.array(*(F.lit(i).cast("long") for i in range(n))) for n in (3, 4))
    s = t("embeddings").select("vec_id", F.explode(seeds).alias("s")).select("vec_id", "s", F.explode(labels).alias("k"))
    s = s.withColumn("p", (F.col("vec_id") * 31 + F.col("s") * 17 + F.col("k") * 7) % 101)  # sums of whole numbers, so equals are equal
    out = metrics.probability_ensemble(s, ["vec_id"], "k", "p")
    return rounded(out.withColumn("probability", F.col("probability") / 101.0))
