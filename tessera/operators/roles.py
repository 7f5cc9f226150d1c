"""Column roles and the problem type: small aggregates in Spark, decisions on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.counts import Counts, counted
from tessera.operators.profile import numeric_columns

# fixed values: parts of names that tell a role, and ends of names that tell a file
TIME_WORDS = (
    "timestamp", "datetime", "date", "time", "period",
    "week", "month", "hour", "day", "year", "quarter",
)
ENTITY_WORDS = (
    "id", "region", "store", "product", "group",
    "entity", "patient", "item", "series",
)
FILE_NAMES = ("filename", "filepath", "file_name", "file_path", "_path", "_url", "_uri")
FILE_ENDS = "png|jpg|jpeg|gif|bmp|tif|tiff|webp|wav|mp3|mp4|pdf|npz|npy|h5|parquet"
ORDINAL_WORDS = ("rating", "score", "grade", "level", "rank", "stars", "severity", "stage")


def _whole(df: DataFrame | Counts, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.IntegralType)


def uniqueness(data: DataFrame | Counts, columns: list[str] | None = None) -> DataFrame:
    """column, n_unique, n_rows, ratio, contiguous (an integer run without gaps), from the table of value counts."""
    facts = counted(data, columns).facts()
    return facts.select("column", "n_unique", "n_rows", F.try_divide(F.col("n_unique").cast("double"), F.col("n_rows")).alias("ratio"), "contiguous")


def id_like(data: DataFrame | Counts, least: float = 0.95, columns: list[str] | None = None) -> DataFrame:
    """Integer columns that number the rows: nearly unique, whether or not without gaps. A 0/1 flag isn't one, though its values are a run."""
    whole = [c for c in columns or data.columns if _whole(data, c)]
    return uniqueness(data, whole).select("column", "n_unique", "contiguous", (F.col("ratio") >= least).alias("id_like"))


def cardinality_gate(data: DataFrame | Counts, most: int = 50) -> DataFrame:
    """Which columns a model may take: numeric ones, others up to ``most`` values."""
    numbers = numeric_columns(data)
    return uniqueness(data).select("column", "n_unique", F.col("column").isin(numbers).alias("numeric"), (F.col("column").isin(numbers) | (F.col("n_unique") <= most)).alias("kept"))


def infer_target(train: DataFrame, val: DataFrame) -> DataFrame:
    """Columns of train that val lacks, best candidate first: numeric, not named as an id, most values."""
    only = [c for c in train.columns if c not in val.columns]
    numbers = numeric_columns(train)
    out = uniqueness(train.select(only), only).select("column", "n_unique", F.col("column").isin(numbers).alias("numeric"))
    named = F.lower("column").rlike(r"(^|_)(id|key)$|key$")
    return out.withColumn("position", F.row_number().over(_order(F.desc((F.col("numeric") & ~named).cast("int")), F.desc("n_unique"), "column")))


def _order(*by):
    from pyspark.sql import Window

    return Window.orderBy(*by)


def parse_rate(df: DataFrame, column: str) -> DataFrame:
    """Shares of non-null values that read as a timestamp and as a number."""
    c = F.col(column).cast("string")
    seen = df.where(F.col(column).isNotNull())
    return seen.agg(F.avg(F.try_to_timestamp(c).isNotNull().cast("double")).alias("dates"), F.avg(c.try_cast("double").isNotNull().cast("double")).alias("numbers"))


def time_score(name: str, n_unique: int, n_rows: int, dates: float, text: bool) -> float:
    """How much a column looks like the time axis."""
    share = n_unique / n_rows if n_rows else 0.0
    score = 100 + share if text and dates > 0.9 else 0.0
    if any(w in name.lower() for w in TIME_WORDS) and n_unique >= 5:
        score += 10
        if 1e-4 < share < 0.5:
            score += 8 * share
    return score


def find_time(data: DataFrame | Counts, exclude: tuple[str, ...] = ()) -> str | None:
    """The column with the best time score; timestamps and dates count as parsed."""
    counts = counted(data)
    facts = {r["column"]: r for r in counts.facts().collect()}
    texts = counts.named(T.StringType)
    rates = {r["column"]: r["dates"] for r in counts.parse_rates(texts).collect()} if texts else {}
    best = (0.0, None)
    for f in counts.schema:
        if f.name in exclude:
            continue
        native = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        dates = 1.0 if native else rates.get(f.name) or 0.0
        best = max(best, (time_score(f.name, facts[f.name]["n_unique"], facts[f.name]["n_rows"], dates, native or f.name in texts), f.name), key=lambda x: x[0])
    return best[1]


def find_id(data: DataFrame | Counts, exclude: tuple[str, ...] = (), least: float = 0.95) -> str | None:
    """Of the integer columns that number the rows, one that is named as a row id, or else the first."""
    names = [c for c in data.columns if c not in exclude and _whole(data, c)]
    found = {r["column"] for r in id_like(data, least, names).where("id_like").collect()} if names else set()
    named = [c for c in names if c in found and c.lower() in ("id", "row_id", "index", "record_id")]
    return next((c for c in [*named, *names] if c in found), None)


def group_candidates(df: DataFrame | Counts, exclude: tuple[str, ...] = (), most: int = 500) -> DataFrame:
    """Columns that may key a panel: few values for many rows, text or an integer that is named as an entity."""
    names = [c for c in df.columns if c not in exclude]
    texts = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    entity = [c for c in names if _whole(df, c) and re.search(r"(^|_|\b)(" + "|".join(ENTITY_WORDS) + r")($|_|\b)", c.lower())]
    facts = uniqueness(df, names)
    text_ok = F.col("column").isin(texts) & (F.col("n_unique") <= F.greatest(F.lit(most), F.col("n_rows") * 0.02))
    whole_ok = F.col("column").isin(entity) & (F.col("n_unique") <= 200)
    return facts.select("column", "n_unique", "ratio", ((F.col("ratio") <= 0.5) & (F.col("n_unique") >= 2) & (text_ok | whole_ok)).alias("candidate"))


def file_named(column: str) -> bool:
    """Whether a column's name says that it holds files."""
    return any(part in column.lower() for part in FILE_NAMES)


def file_like(df: DataFrame, column: str) -> DataFrame:
    """Share of values that end like a file's name, and whether that is half of them or the column is named so."""
    share = F.avg(F.lower(F.col(column)).rlike(rf"\.({FILE_ENDS})$").cast("double"))
    return df.where(F.col(column).isNotNull()).agg(share.alias("share")).withColumn("file_like", F.coalesce(F.col("share") >= 0.5, F.lit(False)) | F.lit(file_named(column)))


@dataclass
class Problem:
    kind: str
    subtype: str
    confidence: str
    reasons: list[str] = field(default_factory=list)


def classify(df: DataFrame, target: str | None, time: str | None, groups: list[str]) -> Problem:
    """panel_forecasting, time_series, tabular_regression or tabular_classification, with its subtype."""
    if target is None:
        return Problem("unknown", "unknown", "low", ["no target"])
    if time and groups:
        return Problem("panel_forecasting", "panel_forecasting", "high", [f"time {time}", f"groups {groups}"])
    if time:
        return Problem("time_series", "time_series", "high", [f"time {time}"])
    kind = subtype_of(df, target)
    sort = "tabular_classification" if kind in ("binary", "multiclass") else "tabular_regression"
    return Problem(sort, kind, "high", [f"{target} is {kind}"])


def subtype_of(df: DataFrame, target: str) -> str:
    """binary, multiclass, ordinal_regression or continuous_regression, by the target's values and name."""
    c = F.col(target)
    n = df.agg(F.count_distinct(c)).first()[0]
    if n == 2:
        return "binary"
    if target not in numeric_columns(df):
        return "multiclass"
    lo, hi, whole = df.agg(F.min(c), F.max(c), F.min((c == F.floor(c)).cast("int"))).first()
    if n > 50 or not whole:
        return "continuous_regression"
    consecutive = n / (hi - lo + 1) >= 0.9
    if any(w in target.lower() for w in ORDINAL_WORDS) or consecutive and n > 2 and lo >= 0 and hi <= 10 and "class" not in target.lower():
        return "ordinal_regression"
    return "multiclass"


def column_kinds(df: DataFrame | Counts, columns: list[str]) -> DataFrame:
    """column, kind: binary (two values), numeric or text."""
    numbers = numeric_columns(df)
    return uniqueness(df, columns).select("column", F.when(F.col("n_unique") == 2, "binary").when(F.col("column").isin(numbers), "numeric").otherwise("text").alias("kind"))
