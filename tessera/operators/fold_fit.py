"""Preprocessing that is refitted in every cross-validation fold, as stages of a ``pyspark.ml`` pipeline.

The stages work on the rows of ``folds.assign()``, where a row stands once for each fold it is in, with ``fold_id`` and ``role``. A stage is fitted for all
folds together: one aggregate over the rows whose role is ``train``, by fold and column (and category). Its state is that table, so a
fold's validation rows are in no state of that fold, and transforming joins the state to the rows of its fold. Fitted stages are saved with
``write()``: parameters as JSON, the state as Parquet.

Encoders that read the target give a training row what the other *inner* folds of its training rows say (``inner``, by hash of the key), and a
validation row what all of them say. Inner sums are not added up again: they are taken from the totals.

Null categories are a category of their own. A fold without training rows, or a column without values in one, has no state there: nulls stay null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import hash_fold
from tessera.operators.encode import NONE, relational_stats
from tessera.operators.running import exact_medians
from tessera.sources.shared import own_path

ALL = -1  # the inner fold that leaves nothing out
INNER_SEED = 7  # other than that of outer folds by hash


class _Settings(Params):
    columns = Param(Params._dummy(), "columns", "the columns to work on", TypeConverters.toListString)
    how = Param(Params._dummy(), "how", "median or mean", TypeConverters.toString)
    target = Param(Params._dummy(), "target", "the target column", TypeConverters.toString)
    key = Param(Params._dummy(), "key", "the columns that tell rows apart", TypeConverters.toListString)
    inner = Param(Params._dummy(), "inner", "inner folds of the training rows", TypeConverters.toInt)
    smoothing = Param(Params._dummy(), "smoothing", "rows that the overall mean counts for", TypeConverters.toFloat)
    least = Param(Params._dummy(), "least", "categories that a column needs", TypeConverters.toInt)
    skew = Param(Params._dummy(), "skew", "skewness of the group means that a column needs", TypeConverters.toFloat)
    top = Param(Params._dummy(), "top", "groups that the gap is measured to", TypeConverters.toInt)

    def of(self, name: str):
        return self.getOrDefault(name)

    def category(self, column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(NONE))

    def inner_fold(self) -> Column:
        return hash_fold(F.concat_ws("|", *self.of("key")), self.of("inner"), INNER_SEED)

    def sums(self, assigned: DataFrame) -> DataFrame:
        """fold_id, column, category, inner, n, s of the training rows: the one pass over rows of either encoder."""
        cells = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), self.category(c).alias("category")) for c in self.of("columns"))))
        train = assigned.where("role = 'train'").select("fold_id", self.inner_fold().alias("inner"), F.col(self.of("target")).cast("double").alias("y"), cells)
        return train.groupBy("fold_id", "column", "category", "inner").agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("s"))


class _StateWriter(MLWriter):
    def __init__(self, model: _FoldModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.state.write.parquet(f"{path}/state")


class _StateReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> _FoldModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(self.sparkSession.read.parquet(f"{path}/state"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _FoldModel(Model, _Settings, MLReadable, MLWritable):
    """A fitted stage: parameters and a state table."""

    def __init__(self, state: DataFrame | None = None):
        super().__init__()
        self.state = state

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


class _FoldEstimator(Estimator, _Settings, MLReadable, MLWritable):
    """A stage to be fitted: ``table`` makes the state, which is written once."""

    model: type

    def _fit(self, assigned: DataFrame) -> _FoldModel:
        state = self.table(assigned)
        path = own_path(assigned.sparkSession, f"state-{self.uid}")
        state.write.parquet(path)
        return self._copyValues(self.model(assigned.sparkSession.read.schema(state.schema).parquet(path)))

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


def _by_fold(state: DataFrame, columns: list[str], values: list[str]) -> DataFrame:
    """One row a fold, to be broadcast: folds times columns numbers."""
    cells = [F.max(F.when(F.col("column") == c, F.col(v))).alias(f"_{v}_{i}") for i, c in enumerate(columns) for v in values]
    return F.broadcast(state.groupBy("fold_id").agg(*cells))


class FoldImputerModel(_FoldModel):
    """State: fold_id, column, value."""

    def _transform(self, assigned: DataFrame) -> DataFrame:
        columns = self.of("columns")
        out = assigned.join(_by_fold(self.state, columns, ["value"]), "fold_id", "left")
        return out.select(*(F.coalesce(F.col(c).cast("double"), F.col(f"_value_{columns.index(c)}")).alias(c) if c in columns else c for c in assigned.columns))


class FoldImputer(_FoldEstimator):
    """Nulls become the median or the mean of the fold's training rows."""

    model = FoldImputerModel

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, how: str = "median"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(how="median")
        if self.of("how") not in ("median", "mean"):
            raise ValueError(f"{how} is neither median nor mean")

    def table(self, assigned: DataFrame) -> DataFrame:
        columns, train = self.of("columns"), assigned.where("role = 'train'")
        if self.of("how") == "median":
            return exact_medians(train, columns, ["fold_id"]).withColumnRenamed("median", "value")
        means = train.groupBy("fold_id").agg(*(F.avg(c).alias(c) for c in columns))
        return means.unpivot("fold_id", columns, "column", "value")


class FoldScalerModel(_FoldModel):
    """State: fold_id, column, mean, deviation."""

    def _transform(self, assigned: DataFrame) -> DataFrame:
        columns = self.of("columns")
        out = assigned.join(_by_fold(self.state, columns, ["mean", "deviation"]), "fold_id", "left")
        scaled = lambda c, i: ((F.col(c) - F.col(f"_mean_{i}")) / F.col(f"_deviation_{i}")).alias(c)
        return out.select(*(scaled(c, columns.index(c)) if c in columns else c for c in assigned.columns))


class FoldScaler(_FoldEstimator):
    """Columns less the training mean, over the training sample deviation; a deviation of 0 or null counts as 1."""

    model = FoldScalerModel

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def table(self, assigned: DataFrame) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias("deviation")) for c in self.of("columns")]
        return assigned.where("role = 'train'").groupBy("fold_id").agg(F.array(*cells).alias("cells")).select("fold_id", F.inline("cells"))


class _EncoderModel(_FoldModel):
    def looked_up(self, assigned: DataFrame, column: str, values: list[str]) -> DataFrame:
        """The rows with the state of their fold, category and left-out inner fold; values of unseen categories are those of the row without a category."""
        own = self.state.where(F.col("column") == column)
        left_out = F.when(F.col("role") == "train", self.inner_fold()).otherwise(F.lit(ALL))
        rows = assigned.withColumns({"_category": self.category(column), "_left_out": left_out})
        seen = own.where("category is not null").select("fold_id", F.col("category").alias("_category"), F.col("left_out").alias("_left_out"), *(F.col(v).alias(f"_{v}") for v in values))
        rest = own.where("category is null").select("fold_id", F.col("left_out").alias("_left_out"), *(F.col(v).alias(f"_other_{v}") for v in values))
        out = rows.join(seen, ["fold_id", "_category", "_left_out"], "left").join(F.broadcast(rest), ["fold_id", "_left_out"], "left")
        return out.withColumns({f"_{v}": F.coalesce(f"_{v}", f"_other_{v}") for v in values})


class FoldTargetEncoderModel(_EncoderModel):
    """State: fold_id, column, category (null: those not seen), left_out, encoded."""

    def _transform(self, assigned: DataFrame) -> DataFrame:
        out = assigned
        for c in self.of("columns"):
            out = self.looked_up(out, c, ["encoded"]).select(*out.columns, F.col("_encoded").alias(f"{c}_te"))
        return out


class FoldTargetEncoder(_FoldEstimator):
    """{column}_te: (n * mean + smoothing * overall mean) / (n + smoothing); the overall mean is that of all training rows of the fold."""

    model = FoldTargetEncoderModel

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, target: str | None = None, key: list[str] | None = None, inner: int = 5, smoothing: float = 10.0):
        super().__init__()
        self._setDefault(inner=5, smoothing=10.0)
        self._set(**self._input_kwargs)

    def table(self, assigned: DataFrame) -> DataFrame:
        own = self.sums(assigned)
        of = Window.partitionBy("fold_id", "column", "category")
        both = own.withColumns({"all_n": F.sum("n").over(of), "all_s": F.sum("s").over(of)})
        rest = both.select("fold_id", "column", "category", F.col("inner").alias("left_out"), (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_s") - F.col("s")).alias("s"))
        total = own.groupBy("fold_id", "column", "category").agg(F.lit(ALL).alias("left_out"), F.sum("n").alias("n"), F.sum("s").alias("s"))
        overall = total.groupBy("fold_id", "column").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))
        k = F.lit(self.of("smoothing"))
        seen = rest.unionByName(total).join(F.broadcast(overall), ["fold_id", "column"])
        encoded = (F.col("s") + k * F.col("mean")) / (F.col("n") + k)
        out = F.explode(F.sequence(F.lit(ALL), F.lit(self.of("inner") - 1)))
        unseen = overall.select("fold_id", "column", F.lit(None).cast("string").alias("category"), out.alias("left_out"), F.col("mean").alias("encoded"))
        return seen.select("fold_id", "column", "category", "left_out", encoded.alias("encoded")).unionByName(unseen)


class FoldRelationalEncoderModel(_EncoderModel):
    """State: fold_id, column, category (null: those not seen), left_out, rank, peer_mean, gap_to_top; null where the column doesn't qualify in the fold."""

    def _transform(self, assigned: DataFrame) -> DataFrame:
        values, out = ["rank", "peer_mean", "gap_to_top"], assigned
        for c in self.of("columns"):
            out = self.looked_up(out, c, values).select(*out.columns, *(F.col(f"_{v}").alias(f"{c}_{v}") for v in values))
        return out


class FoldRelationalEncoder(_FoldEstimator):
    """{column}_rank, _peer_mean and _gap_to_top: the dense rank of the group's mean target from the highest, the mean of the other groups' means, the mean less that
    of the top groups. Only where a fold's training rows have ``least`` groups and their means a skewness of ``skew``; null elsewhere.
    A group that is not seen has the mean rank, the overall mean and no gap."""

    model = FoldRelationalEncoderModel

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, target: str | None = None, key: list[str] | None = None, inner: int = 5, least: int = 20, skew: float = 1.0, top: int = 3):
        super().__init__()
        self._setDefault(inner=5, least=20, skew=1.0, top=3)
        self._set(**self._input_kwargs)

    def table(self, assigned: DataFrame) -> DataFrame:
        own, by = self.sums(assigned), ["fold_id", "column"]
        total = own.groupBy(*by, "category").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
        outs = F.explode(F.sequence(F.lit(ALL), F.lit(self.of("inner") - 1))).alias("left_out")
        parts = own.select(*by, "category", F.col("inner").alias("left_out"), "n", "s")
        rest = total.select("*", outs).join(parts, [*by, "category", "left_out"], "left")
        n, s = (F.col(f"all_{x}") - F.coalesce(x, F.lit(0)) for x in "ns")
        means = rest.select(*by, "category", "left_out", F.try_divide(s, n).alias("mean")).where("mean is not null")
        stats = relational_stats(means, "category", "mean", [*by, "left_out"], self.of("top"))
        whole = stats.where(F.col("left_out") == ALL).groupBy(*by).agg(F.skewness("group_mean").alias("skew"))
        groups = total.groupBy(*by).agg(F.count("*").alias("groups"), F.try_divide(F.sum("all_s"), F.sum("all_n")).alias("mean"))
        worth = groups.join(whole, by).where((F.col("groups") >= self.of("least")) & (F.col("skew") >= self.of("skew"))).select(*by, "mean")
        kept = stats.join(F.broadcast(worth), by)
        seen = kept.select(*by, "category", "left_out", F.col("group_rank").cast("double").alias("rank"), "peer_mean", "gap_to_top")
        unseen = kept.groupBy(*by, "left_out").agg(F.avg("group_rank").alias("rank"), F.max("mean").alias("peer_mean"))
        return seen.unionByName(unseen.select(*by, F.lit(None).cast("string").alias("category"), "left_out", "rank", "peer_mean", F.lit(0.0).alias("gap_to_top")))


@dataclass
class Built:
    """Stages in order, the columns that they add, and the categories that are left to the model."""

    stages: list[Estimator]
    encoded: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)


def build(steps: list[dict], target: str, key: list[str], model: str = "boosted") -> Built:
    """Stages from a contract's steps (name, targets and settings): ``impute_missing``, ``group_relational``, ``target_encode``, ``scale_features``.

    A boosted model needs no scale and takes categories as they are: its columns of ``target_encode`` come back as ``categorical``. A linear one has them encoded, and
    scaled with the rest. Whatever the order of the steps, numbers are filled first and scaled last.
    """
    if model not in ("boosted", "linear"):
        raise ValueError(f"{model} is neither boosted nor linear")
    known = ("impute_missing", "group_relational", "target_encode", "scale_features")
    if odd := [s.get("name") for s in steps if s.get("name") not in known]:
        raise ValueError(f"unknown steps {odd}")
    of = {s["name"]: s for s in steps if s.get("targets")}
    out = Built([])
    if s := of.get("impute_missing"):
        out.stages.append(FoldImputer(columns=s["targets"], how=s.get("strategy", "median")))
    if s := of.get("group_relational"):
        names = {"min_cardinality": "least", "skew_threshold": "skew", "top_k": "top", "inner_folds": "inner"}
        out.stages.append(FoldRelationalEncoder(columns=s["targets"], target=target, key=key, **{names[k]: v for k, v in s.items() if k in names}))
        out.encoded += [f"{c}_{v}" for c in s["targets"] for v in ("rank", "peer_mean", "gap_to_top")]
    s = of.get("target_encode", {"targets": []})
    if model == "boosted":
        out.categorical = list(s["targets"])
        return out
    if s["targets"]:
        out.stages.append(FoldTargetEncoder(columns=s["targets"], target=target, key=key, smoothing=float(s.get("smoothing", 10.0))))
    made = [f"{c}_te" for c in s["targets"]]
    out.encoded += made
    if scaled := [*of.get("scale_features", {"targets": []})["targets"], *made]:
        out.stages.append(FoldScaler(columns=scaled))
    return out


def fitted(assigned: DataFrame, stages: list[Estimator]) -> DataFrame:
    """The rows of all folds behind stages that are fitted on their folds' training rows."""
    return Pipeline(stages=stages).fit(assigned).transform(assigned)
