"""Cross-validation folds as rows (key, fold_id, role), never as positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import hash_fold
from tessera.operators.submit import numbered
from tessera.sources.shared import own_path


@dataclass(frozen=True)
class Span:
    """A fold over period ranks: training on [train_from, train_to), validation on [valid_from, valid_to)."""

    fold_id: int
    train_from: int
    train_to: int
    valid_from: int
    valid_to: int


def kfold(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    return df.withColumn("fold_id", hash_fold(key, k))


def crossed(df: DataFrame, k: int) -> DataFrame:
    """Rows with a fold of their own, once for each of k folds: ``valid`` in their own and ``train`` in the others."""
    cells = F.array(*(F.struct(F.lit(f).alias("fold_id"), F.when(F.col("fold_id") == f, "valid").otherwise("train").alias("role")) for f in range(k)))
    return df.where(F.col("fold_id").isNotNull()).withColumn("_cells", cells).drop("fold_id").select("*", F.inline("_cells")).drop("_cells")


def stratified(df: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """Folds of equal class shares: rows of a class are numbered by hash. A class of a third of all rows is numbered by slices of its hash."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit("|42")))
    part = F.substring(h, 1, 2)
    rows = df.withColumns({"_h": h, "_p": part})
    before = rows.groupBy(label, "_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy(label).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(label, "_p").orderBy("_h", key)) - 1
    out = rows.withColumn("_n", place).join(before.select(label, "_p", "_before"), [label, "_p"])
    return out.withColumn("fold_id", ((F.col("_n") + F.col("_before")) % k).cast("int")).drop("_h", "_p", "_n", "_before")


def sequential(df: DataFrame, order: list[str], share: float = 0.8) -> DataFrame:
    """fold_id 0 and role: the first rows by ``order`` train, the rest is held out; where nothing groups or times the rows."""
    rows = numbered(df, order)
    cut = holdout_cut(rows.count(), share)
    return rows.withColumns({"fold_id": F.lit(0), "role": F.when(F.col("row_id") < cut, "train").otherwise("valid")}).drop("row_id")


def strict(df: DataFrame, groups: list[str], order: list[str], k: int = 4) -> tuple[DataFrame, str]:
    """(rows with fold_id and role, scheme) of tables without a time axis: whole groups of the first group column that is there, else sequential()."""
    group = next((g for g in groups if g in df.columns), None)
    if group is None:
        return sequential(df, order), "80/20 sequential"
    folded = group_folds(df, group, k)
    n = max(2, min(k, folded.select("fold_id").distinct().count()))
    return crossed(folded, n), f"{n} folds of {group}"


def turns(loads: list[int], size: int) -> list[tuple[int, list[int]]]:
    """How groups of one size are dealt, each to the lightest fold (the first of equals): (rank from which, folds in turn). The lightest fold takes groups until it reaches the
    next one, the two then take turns until they reach the third, and so on: at most one entry a fold, however many groups there are."""
    waiting = sorted((load, f) for f, load in enumerate(loads))
    active, out, rank = [waiting.pop(0)], [], 0
    while True:
        active.sort()
        if not waiting:
            return [*out, (rank, [f for _, f in active])]
        load, fold = waiting[0]
        taken = [max(0, -(-(load - own) // size) + (1 if (load - own) % size == 0 and f < fold else 0)) for own, f in active]
        if total := sum(taken):
            out.append((rank, [f for _, f in active]))
            rank += total
        active = [(own + n * size, f) for (own, f), n in zip(active, taken, strict=True)] + [waiting.pop(0)]


def dealt(loads: list[int], size: int, n: int) -> list[int]:
    """The loads when n groups of one size have been dealt."""
    out, parts = list(loads), turns(loads, size)
    for i, (start, folds) in enumerate(parts):
        end = min(n, parts[i + 1][0]) if i + 1 < len(parts) else n
        for j, f in enumerate(folds):
            out[f] += size * max(0, (end - start - j + len(folds) - 1) // len(folds))
    return out


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Whole groups to folds: the largest group to the lightest fold, and so on down (of equals in the group's order to the first fold), so that folds differ by the largest group at most; no more
    folds than groups. Groups of one size are dealt together by their rank: the driver sees one row for each distinct size, of which n rows have fewer than sqrt(2 n)."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_size"))
    ranked = numbered(sizes, [F.desc("_size"), F.col(group).asc_nulls_last()])
    steps = ranked.groupBy("_size").agg(F.count("*").alias("n"), F.min("row_id").alias("first")).orderBy(F.desc("_size")).collect()
    loads, rows = [0] * max(2, min(k, sum(s["n"] for s in steps))), []
    for s in steps:
        rows.append((s["_size"], s["first"], [(start, folds) for start, folds in turns(loads, s["_size"])]))
        loads = dealt(loads, s["_size"], s["n"])
    plan = df.sparkSession.createDataFrame(rows, "_size long, _first long, _turns array<struct<start:long,folds:array<int>>>")
    rank = F.col("row_id") - F.col("_first")
    now = F.element_at(F.filter("_turns", lambda t: t["start"] <= rank), -1)
    fold = F.get(now["folds"], F.pmod(rank - now["start"], F.size(now["folds"])).cast("int"))
    folds = ranked.join(plan, "_size").select(F.col(group).alias("_group"), fold.alias("fold_id"))
    return df.join(folds, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def expanding(periods: int, splits: int, valid: int, gap: int = 0, window: int | None = None) -> list[Span]:
    """Folds counted back from the last period; window: a sliding training span of so many periods. Those without training rows are left out."""
    out = []
    for i in range(splits):
        start = periods - (i + 1) * valid
        end = start - gap
        if start <= 0 or end <= 0:
            break
        out.append((max(0, end - window) if window else 0, end, start, start + valid))
    return [Span(i, *s) for i, s in enumerate(reversed(out))]


def rolling_origin(periods: int, splits: int, valid: int, gap: int = 0, reach: int | None = None) -> list[Span]:
    """Folds counted from the first period."""
    out = []
    for i in range(splits):
        end = (i + 1) * valid
        start = end + gap
        stop = min(start + (reach or valid), periods)
        if start >= periods:
            break
        out.append(Span(i, 0, end, start, stop))
    return out


def purged(periods: int, splits: int, embargo: int = 2) -> list[Span]:
    """Walk-forward folds whose training ends ``embargo`` periods before validation."""
    least = periods // (splits + 1)
    step = max(1, (periods - least) // splits)
    out = []
    for i in range(splits):
        start = least + i * step
        stop = periods if i == splits - 1 else start + step
        if start - embargo > 0 and start < periods:
            out.append(Span(len(out), 0, start - embargo, start, min(stop, periods)))
    return out


def holdout_cut(periods: int, share: float = 0.8) -> int:
    """The first period of the last fifth."""
    return int(share * periods)


def assign(df: DataFrame, rank: str, spans: list[Span]) -> DataFrame:
    """Each row once for each fold it is in, with fold_id and role. Folds are a handful of literals."""
    cells = []
    for s in spans:
        r = F.col(rank)
        role = F.when((r >= s.train_from) & (r < s.train_to), "train").when((r >= s.valid_from) & (r < s.valid_to), "valid")
        cells.append(F.struct(F.lit(s.fold_id).alias("fold_id"), role.alias("role")))
    return df.select("*", F.inline(F.array(*cells))).where("role is not null")


def stored(assigned: DataFrame) -> DataFrame:
    """The rows of assign(), written to the shared folder by fold and read again: a fold's readers open that fold's files alone."""
    path = own_path(assigned.sparkSession, "folds")
    assigned.write.partitionBy("fold_id").parquet(path)
    return assigned.sparkSession.read.schema(assigned.schema).parquet(path)


def mean_length(df: DataFrame, groups: list[str], splits: int = 5) -> DataFrame:
    """mean_length of the groups and the validation size that follows from it where no periods are known: a fold's share, one row at least."""
    n = df.groupBy(*groups).agg(F.count("*").alias("n"))
    return n.agg(F.avg("n").alias("mean_length")).withColumn("valid_size", F.greatest(F.lit(1), F.floor(F.col("mean_length") / (splits + 1)).cast("int")))


def fold_sizes(assigned: DataFrame, rank: str) -> DataFrame:
    """fold_id, rows and period bounds of either role."""
    t, v = (F.col("role") == r for r in ("train", "valid"))
    return assigned.groupBy("fold_id").agg(F.count_if(t).alias("n_train"), F.count_if(v).alias("n_valid"), F.min(F.when(t, F.col(rank))).alias("train_min"), F.max(F.when(t, F.col(rank))).alias("train_max"), F.min(F.when(v, F.col(rank))).alias("valid_min"), F.max(F.when(v, F.col(rank))).alias("valid_max"))


def invariants(assigned: DataFrame, rank: str, gap: int = 0) -> DataFrame:
    """fold_id, ordered: whether training ends more than ``gap`` periods before validation."""
    s = fold_sizes(assigned, rank)
    return s.select("fold_id", F.coalesce(F.col("train_max") + gap < F.col("valid_min"), F.lit(False)).alias("ordered"), "n_train", "n_valid")


def groups_disjoint(folds: DataFrame, group: str) -> DataFrame:
    """Groups that lie in more than one fold; none is what is wanted."""
    return folds.groupBy(group).agg(F.count_distinct("fold_id").alias("n_folds")).where("n_folds > 1")


def oof_metrics(pred: DataFrame, y: str, p: str) -> DataFrame:
    """fold_id, n, mae, rmse, mean and sample deviation of the predictions."""
    e = F.col(y) - F.col(p)
    return pred.groupBy("fold_id").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(p).alias("pred_mean"), F.stddev_samp(p).alias("pred_std"))


def oof_summary(metrics: DataFrame, expected: int) -> DataFrame:
    """mean, population deviation, least and largest MAE over folds, and a verdict."""
    g = metrics.agg(F.count("*").alias("n_folds"), F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"), F.min("mae").alias("mae_min"), F.max("mae").alias("mae_max"))
    return g.withColumn("verdict", F.when(F.col("n_folds") == 0, "NO_FOLDS").when(F.col("n_folds") < expected, "MISSING_FOLDS").when(F.col("mae_std") > 0.5 * F.col("mae_mean"), "UNSTABLE").otherwise("OK"))


def plan(problem: str, periods: int, val_periods: int, first_step: int = 1, sliding: bool = False, splits: int = 5) -> dict:
    """The frozen plan of a split: scheme, sizes, gap and a digest of them."""
    import hashlib
    import json

    gap = max(0, first_step - 1)
    valid = max(1, min(val_periods, periods // (splits + 1) or 1))
    kinds = {"panel_forecasting": "expanding", "time_series": "expanding", "tabular_classification": "stratified"}
    out = {"scheme": "sliding" if sliding and problem in kinds and kinds[problem] == "expanding" else kinds.get(problem, "kfold"), "n_splits": splits, "valid_size": valid, "gap": gap, "frozen": True}
    if out["scheme"] == "sliding":
        out["window_size"] = max(valid, min(3 * valid, periods - valid - gap))
    return out | {"plan_id": hashlib.sha256(json.dumps(out, sort_keys=True).encode()).hexdigest()[:16]}
