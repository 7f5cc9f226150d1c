"""Adversarial validation: can a model tell training rows from those to be predicted, which columns tell, and weights that make the training rows alike.

Size gates come first, then out-of-fold scores by one model a fold, their AUC, and the weights that follow from it: all rows of both sides in one frame, so that
every step is a column. Trees see a column as the bin its value is in, so a fold's model is fitted on its training rows counted by cell (the bins of a row and its side), with the count as
weight: the same model as one of the rows, from a table that doesn't grow with them where columns are few. How much a column tells is how far the AUC falls when its values are swapped among the rows of a fold; all columns are scored in one pass over the same rows and models.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import encode, folds, metrics
from tessera.operators.model import assembler
from tessera.operators.profile import numeric_columns
from tessera.operators.running import running_sums

# fixed values
LEAST_ROWS, LEAST_SIDE, LEAST_COLUMNS, LEAST_AUC = 500, 100, 3, 0.55
LOW, HIGH = 0.1, 10.0
TOP = 5
BUCKETS = 64
BINS = 32  # of a column, as many as a tree's default
MOST_BINS = 512  # lets a fit look at 512 * 512 cells for its thresholds, in place of 10,000


def sides(train: DataFrame, val: DataFrame, key: str, columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(key, is_train and the shared numeric columns of both sides, with training medians for unknown numbers; those columns)."""
    names = [c for c in (columns or train.columns) if c != key and c in val.columns and c in numeric_columns(train) and c in numeric_columns(val)]
    both = train.select(key, *(F.col(c).cast("double").alias(c) for c in names), F.lit(1).alias("is_train"))
    both = both.unionByName(val.select(key, *(F.col(c).cast("double").alias(c) for c in names), F.lit(0).alias("is_train")))
    if not names:
        return both, names
    medians = encode.fit_fill(train, names)
    row = [math.nan if m is None else m for m in medians.first()]  # a column without training numbers: not a number, a bin of its own
    known = train.sparkSession.createDataFrame([row], medians.schema)  # one row, as every pass over both sides needs it
    return encode.impute(both, known, names), names


def gates(both: DataFrame, n_columns: int) -> DataFrame:
    """n_train, n_val, n_columns, skip_reason (null: go on): few rows in all, in a side, few columns, in this order."""
    n = both.agg(F.coalesce(F.sum("is_train"), F.lit(0)).alias("n_train"), F.coalesce(F.sum(1 - F.col("is_train")), F.lit(0)).alias("n_val"), F.lit(n_columns).alias("n_columns"))
    reason = F.when(F.col("n_train") + F.col("n_val") < LEAST_ROWS, "few rows").when(F.col("n_train") < LEAST_SIDE, "few training rows").when(F.col("n_val") < LEAST_SIDE, "few rows to predict").when(F.col("n_columns") < LEAST_COLUMNS, "few columns")
    return n.withColumn("skip_reason", reason)


def judged(scored: DataFrame, n_columns: int) -> DataFrame:
    """gates() of scored rows (is_train, score) with their auc and applied: whether weights are called for."""
    out = gates(scored, n_columns).crossJoin(F.broadcast(metrics.roc_auc(scored, "is_train", "score")))
    low = F.coalesce(F.col("auc") < LEAST_AUC, F.lit(True))
    reason = F.coalesce("skip_reason", F.when(low, "no shift"))
    return out.select("n_train", "n_val", "n_columns", "auc", reason.alias("skip_reason"), reason.isNull().alias("applied"))


def weights(scored: DataFrame, n_columns: int) -> DataFrame:
    """The training rows with weight: 1 - score between 0.1 and 10, over its mean; 1 for all where no weights are called for."""
    train = scored.where("is_train = 1")
    raw = F.least(F.greatest(1 - F.col("score"), F.lit(LOW)), F.lit(HIGH))
    verdict = judged(scored, n_columns).select(F.col("applied").alias("_applied")).crossJoin(F.broadcast(train.agg(F.avg(raw).alias("_mean"))))
    return train.crossJoin(F.broadcast(verdict)).withColumn("weight", F.when(F.col("_applied"), raw / F.col("_mean")).otherwise(F.lit(1.0))).drop("_applied", "_mean")


@dataclass(frozen=True)
class CrossFit:
    """Rows with folds of equal shares of either side, and the model of each fold, fitted on the others."""

    rows: DataFrame
    columns: list[str]
    models: dict[int, PipelineModel]

    def scores(self, rows: DataFrame | None = None) -> DataFrame:
        """The rows with the score of the model that hasn't seen their fold."""
        rows = self.rows if rows is None else rows
        made = [m.transform(rows.where(F.col("fold_id") == f)).withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score") for f, m in sorted(self.models.items())]
        return reduce(DataFrame.union, made)

    def telling(self, top: int = TOP) -> DataFrame:
        """column, auc_without, fall of the columns whose swapped values cost most: each row is scored as it is and once for each column, with that column's value from the next row of its fold by hash."""
        h = F.xxhash64(F.lit(11), *self.columns, "is_train", *[c for c in self.rows.columns if c not in (*self.columns, "is_train", "fold_id")])
        rows = self.rows.withColumns({"_h": h, "_b": F.pmod(h, F.lit(BUCKETS))})
        ring = Window.partitionBy("fold_id", "_b").orderBy("_h")
        whole = Window.partitionBy("fold_id", "_b").orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({f"_o_{c}": F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)) for c in self.columns})
        forms = [F.struct(F.lit(v).alias("_form"), *(F.col(f"_o_{c}" if c == v else c).alias(c) for c in self.columns)) for v in (None, *self.columns)]
        cells = F.array(*(f.cast("struct<_form:string," + ",".join(f"`{c}`:double" for c in self.columns) + ">") for f in forms))
        exploded = rows.select("fold_id", "is_train", F.inline(cells))
        auc = metrics.roc_auc(self.scores(exploded).withColumn("_form", F.coalesce("_form", F.lit(""))), "is_train", "score", ["_form"])
        base = auc.where("_form = ''").select(F.col("auc").alias("_base"))
        out = auc.where("_form <> ''").crossJoin(F.broadcast(base))
        return out.select(F.col("_form").alias("column"), F.col("auc").alias("auc_without"), (F.col("_base") - F.col("auc")).alias("fall")).orderBy(F.desc("fall"), "column").limit(top)


def cuts(rows: DataFrame, columns: list[str], k: int, bins: int = BINS) -> dict[int, list[list[float]]]:
    """By fold, the inner bounds of each column's bins over the rows of the other folds: one bin a value where there are no more values than bins, else bins of
    about equal numbers of rows, with equal values in one bin. They are exact, from counts by value of all folds at once; a bound lies halfway between two bins."""
    pairs = F.inline(F.array(*(F.struct(F.lit(i).alias("column"), F.col(c).alias("v")) for i, c in enumerate(columns))))
    known = rows.select("fold_id", pairs).where("v is not null and not isnan(v)")
    counts = known.groupBy("column", "v").agg(F.count("*").alias("n"), *(F.count_if(F.col("fold_id") == f).alias(f"n_{f}") for f in range(k)))
    counts = counts.select("column", "v", *(x for f in range(k) for x in ((F.col("n") - F.col(f"n_{f}")).alias(f"n_{f}"), (F.col("n") > F.col(f"n_{f}")).cast("long").alias(f"d_{f}"))))
    sums = running_sums(counts, "v", [c for c in counts.columns if c not in ("column", "v")], ["column"], few=True)
    middle = lambda f: F.floor(bins * (F.col(f"cum_n_{f}") - F.col(f"n_{f}") / 2) / F.col(f"all_n_{f}"))
    place = lambda f: F.when(F.col(f"all_d_{f}") <= bins, F.col(f"cum_d_{f}")).otherwise(middle(f))
    cells = F.inline(F.array(*(F.struct(F.lit(f).alias("fold"), F.when(F.col(f"d_{f}") > 0, place(f)).alias("bin")) for f in range(k))))
    ends = sums.select("column", "v", cells).where("bin is not null").groupBy("fold", "column", "bin").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    before = F.lag("high").over(Window.partitionBy("fold", "column").orderBy("bin"))
    half = before / 2 + F.col("low") / 2
    bound = F.when((half > before) & (half <= F.col("low")), half).otherwise(F.col("low"))
    out: dict[int, list[list[float]]] = {f: [[] for _ in columns] for f in range(k)}
    for r in ends.withColumns({"bound": bound, "before": before}).where("before is not null and abs(bound) < double('infinity')").collect():
        out[r["fold"]][r["column"]].append(r["bound"])
    return {f: [sorted(c) for c in of] for f, of in out.items()}


def cross_fit(both: DataFrame, key: str, columns: list[str], k: int = 5, rounds: int = 20, depth: int = 6, workers: int = 4) -> CrossFit:
    """One classifier a fold, fitted side by side on the fold's training rows counted by cell."""
    rows = folds.stored(folds.stratified(both, key, "is_train", k))
    inner, binned = cuts(rows, columns, k), [f"_bin_{c}" for c in columns]

    def fitted(f: int) -> PipelineModel:
        ends = [[-math.inf, *(c or [0.0]), math.inf] for c in inner[f]]  # a column of one value needs some bound; all its rows lie in one bin
        bins = Bucketizer(splitsArray=ends, inputCols=columns, outputCols=binned, handleInvalid="keep")
        cells = bins.transform(rows.where(F.col("fold_id") != f)).groupBy(*((F.col(b) + 0.0).alias(b) for b in binned), "is_train").agg(F.count("*").cast("double").alias("_n"))  # + 0.0: numbers in order, not the categories a Bucketizer makes
        model = GBTClassifier(labelCol="is_train", weightCol="_n", maxIter=rounds, maxDepth=depth, stepSize=0.05, seed=42, maxBins=MOST_BINS)
        return PipelineModel([bins, *Pipeline(stages=[*assembler(cells, binned), model]).fit(cells).stages])

    with ThreadPoolExecutor(workers) as pool:
        models = list(pool.map(inheritable_thread_target(both.sparkSession)(fitted), range(k)))
    return CrossFit(rows, columns, dict(enumerate(models)))


@dataclass(frozen=True)
class Shift:
    """summary (one row of judged()), weights of the training rows (key, weight) and the most telling columns; without a model where a gate is shut."""

    summary: DataFrame
    weights: DataFrame
    top: DataFrame


def validate(train: DataFrame, val: DataFrame, key: str, columns: list[str] | None = None, **how) -> Shift:
    """The whole check of a training table and the rows to predict."""
    both, names = sides(train, val, key, columns)
    shut = gates(both, len(names)).first()["skip_reason"]
    spark = train.sparkSession
    if shut:
        summary = gates(both, len(names)).select("n_train", "n_val", "n_columns", F.lit(None).cast("double").alias("auc"), "skip_reason", F.lit(False).alias("applied"))
        return Shift(summary, train.select(key, F.lit(1.0).alias("weight")), spark.createDataFrame([], "column string, auc_without double, fall double"))
    fit = cross_fit(both, key, names, **how)
    scored = fit.scores()
    return Shift(judged(scored, len(names)), weights(scored, len(names)).select(key, "weight"), fit.telling())
