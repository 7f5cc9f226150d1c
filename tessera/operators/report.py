"""A Markdown report and a JSON-lines log of a run, from small collected frames."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# one schema of keys that writers and the report share
SECTIONS = ("classification", "quality", "features", "modeling", "validation", "forecast", "submission", "risks")


def table(df: DataFrame, most: int = 50) -> str:
    """A frame's first rows as a Markdown table."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    show = lambda v: f"{v:.4g}" if isinstance(v, float) else v
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(show(v) for v in r) for r in rows)])


def report(title: str, sections: dict[str, str | DataFrame], time_axis: bool = True) -> str:
    """Sections in their fixed order; the forecast only where there is a time axis. An unknown section is an error."""
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    out = [f"# {title}"]
    for s in SECTIONS:
        if s in sections and (s != "forecast" or time_axis):
            body = sections[s]
            out += [f"## {s.capitalize()}", body if isinstance(body, str) else table(body)]
    return "\n\n".join(out) + "\n"


@dataclass(frozen=True)
class Part:
    """A stage's table in the report: its section, heading, the columns that it must have, and a sentence made of its first row."""

    section: str
    heading: str
    columns: tuple[str, ...]
    sentence: Callable[[dict[str, Any]], str] | None = None


def _number(v: Any, digits: int = 4) -> str:
    return "unknown" if v is None else f"{v:,.{digits}f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) else str(v)


#: What stages store and the report reads: one schema of keys for both.
PARTS: dict[str, Part] = {
    "problem": Part("classification", "Problem", ("kind", "subtype", "target"), lambda r: f"The target {r['target']} makes this a case of {r['kind']} ({r['subtype']})."),
    "horizons": Part("classification", "Periods to forecast", ("step", "gap")),
    "profile": Part("quality", "Columns", ("column", "dtype", "n_unique", "n_null", "null_pct")),
    "missing": Part("quality", "Missing values", ("missing_pct",), lambda r: f"On average {_number(r['missing_pct'], 2)} % of a column's values are missing."),
    "shift": Part("quality", "Shift between training and forecast", ("feature", "statistic", "p_value", "flagged")),
    "families": Part("features", "Families", ("family", "n_columns", "refused")),
    "adversarial": Part("features", "Adversarial validation", ("auc", "skip_reason", "applied"), lambda r: "Training rows are weighed." if r["applied"] else f"Training rows are not weighed: {r['skip_reason']}."),
    "search": Part("modeling", "Settings", ("rung", "number", "rate", "depth", "rounds", "mae")),
    "folds": Part("modeling", "Folds", ("fold_id", "n", "mae", "rmse")),
    "importance": Part("modeling", "Importance", ("feature", "share")),
    "skill": Part("modeling", "Against the baseline", ("mae", "baseline_mae", "skill"), lambda r: f"The error of {_number(r['mae'])} is {_number(100 * r['skill'], 1)} % below the baseline's {_number(r['baseline_mae'])}." if r["skill"] > 0 else f"The error of {_number(r['mae'])} does not beat the baseline's {_number(r['baseline_mae'])}."),
    "stability": Part("validation", "Stability of the folds", ("variation", "verdict"), lambda r: f"The folds' errors vary by {_number(r['variation'], 2)} of their mean: {r['verdict']}."),
    "gap": Part("validation", "Strict re-run", ("gap", "cv_integrity", "importance_concentration", "leakage_two_signal", "verdict"), lambda r: f"The strict error is {_number(100 * (r['gap'] or 0.0), 1)} % above the reported one: {r['verdict']}."),
    "cause": Part("validation", "Cause of the gap", ("cause", "explained")),
    "suspects": Part("validation", "Suspect features", ("feature", "suspect")),
    "recursion": Part("forecast", "Recursion against the last known value", ("step", "recursive_mae", "last_known_mae", "choice")),
    "predictions": Part("submission", "Predictions", ("min", "max", "mean", "std", "n_null", "n_negative"), lambda r: f"Predictions lie between {_number(r['min'])} and {_number(r['max'])}."),
    "round_trip": Part("submission", "Round trip", ("n_rows", "n_unmatched", "n_different", "passed"), lambda r: "All rows came back as they were predicted." if r["passed"] else f"{_number(r['n_unmatched'])} rows found no prediction, {_number(r['n_different'])} differ."),
    "risks": Part("risks", "Risks", ("risk",)),
}


def store(df: DataFrame, folder: str, key: str) -> None:
    """A stage's table, for the report. A key or a table that the report doesn't know is an error."""
    part = PARTS.get(key)
    if part is None:
        raise ValueError(f"unknown part of a report: {key}")
    if missing := [c for c in part.columns if c not in df.columns]:
        raise ValueError(f"{key} lacks {missing}")
    df.write.mode("overwrite").parquet(f"{folder}/{key}")


def recommendation(rows: dict[str, dict[str, Any]]) -> str:
    """What to do, from the first rows of the parts: a failed round trip first, then the validator, then the folds."""
    trip, gap, stable, cause = (rows.get(k, {}) for k in ("round_trip", "gap", "stability", "cause"))
    if trip and not trip["passed"]:
        return "FIX: the submission does not come back as it was predicted."
    if gap.get("verdict") == "CRITICAL" and cause.get("cause") != "CV_SCHEME" or gap.get("leakage_two_signal") == "CRITICAL":
        return "REVIEW: the cross-validation or a feature is in doubt."
    if gap.get("verdict") in ("CRITICAL", "WARNING") and cause.get("cause") != "CV_SCHEME" or stable.get("verdict") in ("CV_RISK", "CV_INVALID"):
        return "SUBMIT WITH CAUTION: see the validation."
    if gap.get("verdict") in ("CRITICAL", "WARNING"):
        return "SUBMIT: the gap comes from the stricter scheme, not from the model."
    return "SUBMIT"


def build(spark: SparkSession, folder: str, title: str, most: int = 50) -> str:
    """The report of the stages' tables in a folder: a recommendation, then every section that has a part, its sentences and the first ``most`` rows of its tables, and which parts
    are missing. The forecast's section stands only where there are periods to forecast."""
    tables = {k: spark.read.parquet(f"{folder}/{k}") for k in PARTS if _there(spark, f"{folder}/{k}")}
    rows = {k: (r.asDict() if (r := t.first()) else {}) for k, t in tables.items()}
    sections: dict[str, list[str]] = {}
    for k, t in tables.items():
        part = PARTS[k]
        said = [part.sentence(rows[k])] if part.sentence and rows[k] else []
        sections.setdefault(part.section, []).extend([f"### {part.heading}", *said, table(t.select(*part.columns), most)])
    sections.setdefault("risks", []).append("Not stored: " + (", ".join(k for k in PARTS if k not in tables) or "nothing") + ".")
    body = report(title, {s: "\n\n".join(b) for s, b in sections.items()}, time_axis="horizons" in tables or "recursion" in tables)
    head, _, rest = body.partition("\n\n")
    return f"{head}\n\n**{recommendation(rows)}**\n\n{rest}"


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class Log:
    """Events of a run, a JSON line each; lists are cut to ``most`` entries."""

    KINDS = ("profile", "plan", "features", "model", "verdict", "rejected_hypothesis", "submission")

    def __init__(self, path: str, most: int = 10):
        self.path, self.most = Path(path), most

    def add(self, kind: str, **facts: Any) -> None:
        if kind not in self.KINDS:
            raise ValueError(f"unknown kind of event: {kind}")
        short = {k: v[: self.most] if isinstance(v, list) else v for k, v in facts.items()}
        with self.path.open("a") as f:
            f.write(json.dumps({"kind": kind, "at": datetime.now(UTC).isoformat(), **short}, default=str) + "\n")

    def read(self) -> list[dict[str, Any]]:
        return [json.loads(line) for line in self.path.read_text().splitlines()] if self.path.exists() else []


def preflight(python: tuple[int, int] = (3, 10), spark: str = "3.5") -> list[str]:
    """What the environment lacks."""
    import sys

    import pyspark

    out = [] if sys.version_info[:2] >= python else [f"Python {sys.version_info[0]}.{sys.version_info[1]}"]
    number = lambda v: tuple(int(x) for x in v.split(".")[:2])
    return out + ([] if number(pyspark.__version__) >= number(spark) else [f"PySpark {pyspark.__version__}"])
