"""Putting tables together: routing, unions, left folds, expansion and key audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_share(df: DataFrame, column: str) -> DataFrame:
    """n_rows and the share of nulls of one column."""
    return df.agg(F.count("*").alias("n_rows"), F.avg(F.col(column).isNull().cast("double")).alias("null_share"))


def route_files(tables: dict[str, DataFrame], target: str | None, hints: dict[str, str] | None = None) -> dict[str, tuple[str, str]]:
    """name -> (train, val or submission; why). A name comes first, then the target's nulls, then a hint; a val table with a known target is train."""
    out = {}
    for name, df in sorted(tables.items()):
        low = name.lower()
        share = null_share(df, target).first()["null_share"] if target in df.columns else None
        if "submission" in low:
            out[name] = ("submission", "name")
        elif share is not None and share < 0.5 and not any(w in low for w in ("val", "test", "eval")):
            out[name] = ("train", "target is known")
        elif share is not None and share >= 0.5:
            out[name] = ("submission", "target is empty")
        elif share is not None:
            out[name] = ("train", "target is known in spite of the name")
        elif any(w in low for w in ("train", "fit")):
            out[name] = ("train", "name")
        elif any(w in low for w in ("val", "test", "eval", "feature")):
            out[name] = ("val", "name")
        else:
            out[name] = ((hints or {}).get(name, "train"), "hint" if name in (hints or {}) else "default")
    return out


def union_files(frames: list[DataFrame]) -> DataFrame:
    """All rows; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def left_fold(frames: list[DataFrame]) -> DataFrame:
    """Left joins, one after the other, on all columns that the next table shares; a table that shares none is an error."""

    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        keys = [c for c in a.columns if c in b.columns]
        if not keys:
            raise ValueError(f"no shared column to join {b.columns} on")
        return a.join(b, keys, "left")

    return reduce(step, frames)


def assemble_train(covariates: list[DataFrame], targets: list[DataFrame]) -> DataFrame:
    """Union of the covariate tables left-joined with the union of the target tables."""
    return left_fold([union_files(covariates), union_files(targets)]) if targets else union_files(covariates)


def stack_splits(train: DataFrame, val: DataFrame, target: str) -> DataFrame:
    """Train over val with an explicit is_train flag and a null target in val."""
    blank = val.withColumn(target, F.lit(None).cast(train.schema[target].dataType))
    return train.withColumn("is_train", F.lit(True)).unionByName(blank.withColumn("is_train", F.lit(False)), allowMissingColumns=True)


def expand_groups(val: DataFrame, train: DataFrame, missing: list[str]) -> DataFrame:
    """Val with every known combination of group columns that it lacks; meant for the few values of a group key."""
    return val.crossJoin(train.select(*missing).distinct())


def coalesce_blocks(df: DataFrame, first: DataFrame, second: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Attaches columns from two tables by key, the first's values before the second's."""
    a = first.select(*key, *(F.col(c).alias(f"_a_{c}") for c in columns))
    b = second.select(*key, *(F.col(c).alias(f"_b_{c}") for c in columns))
    out = df.join(a, key, "left").join(b, key, "left")
    return out.select(*df.columns, *(F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in columns))


def last_known(train: DataFrame, groups: list[str], axis: str, target: str) -> DataFrame:
    """Each group's target at its own last period that has one."""
    seen = train.where(F.col(target).isNotNull())
    return seen.groupBy(*groups).agg(F.max_by(target, axis).alias("last_known"))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of left that right lacks."""
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")


def link_ratio(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Share of left's distinct values that right has too."""
    ids = left.select(column).where(F.col(column).isNotNull()).distinct()
    hit = ids.join(right.select(column).distinct().withColumn("_hit", F.lit(1)), column, "left")
    return hit.agg(F.count("*").alias("n_ids"), F.count("_hit").alias("n_linked"), F.try_divide(F.count("_hit").cast("double"), F.count("*")).alias("link_ratio"))


def scored_filter(train: DataFrame, template: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_train, n_template, scored: whether the template has some but not all of train's values and no others."""
    rows = []
    for c in columns:
        t, s = train.select(F.col(c).alias("v")).distinct(), template.select(F.col(c).alias("v")).distinct()
        both = t.withColumn("a", F.lit(1)).join(s.withColumn("b", F.lit(1)), "v", "full")
        rows.append(both.agg(F.lit(c).alias("column"), F.count("a").alias("n_train"), F.count("b").alias("n_template"), F.count_if(F.col("a").isNull()).alias("extra")))
    facts = reduce(DataFrame.union, rows)
    return facts.select("column", "n_train", "n_template", ((F.col("extra") == 0) & (F.col("n_template") > 0) & (F.col("n_template") < F.col("n_train"))).alias("scored"))


def scored_rows(df: DataFrame, template: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose values the template has, in every scored column."""
    return reduce(lambda d, c: d.join(template.select(c).distinct(), c, "left_semi"), columns, df)


def numeric_only(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Numeric columns and those named."""
    from tessera.operators.profile import numeric_columns

    numbers = set(numeric_columns(df))
    return df.select(*(c for c in df.columns if c in numbers or c in keep))


def assert_no_nulls(df: DataFrame, columns: list[str]) -> None:
    """Raises where a column that must be known has nulls or NaN."""
    bad = df.agg(*(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns)).first().asDict()
    if any(bad.values()):
        raise ValueError(f"unknown values: { {c: n for c, n in bad.items() if n} }")
