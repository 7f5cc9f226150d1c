"""Search for settings of boosted trees: successive halving over fits that run side by side, with a deadline, and the second cycle after a review.

All settings start with a few boosting rounds; after each rung the better half goes on with twice as many. The fits of a rung are submitted from a pool of
threads, so that a small one doesn't leave the cluster idle, each under a job tag and in a scheduler pool of its own. At the deadline the tag's jobs are cancelled
and the best setting of the last finished rung holds. Settings are drawn before any fit runs and compared by error and number, so the result
doesn't depend on which fit ends first.
"""

from __future__ import annotations

import math
import random
import time
import uuid
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.folds import stored
from tessera.operators.model import fit_predict, gbt


# fixed values
RATE, DEPTH = (0.02, 0.10), (4, 8)
WIDE_RATE, WIDE_DEPTH = (0.005, 0.15), (4, 10)


@dataclass(frozen=True)
class Space:
    """Bounds that settings are drawn from; the rate on a logarithmic scale."""

    rate: tuple[float, float] = RATE
    depth: tuple[int, int] = DEPTH

    def draw(self, rng: random.Random) -> dict:
        low, high = map(math.log, self.rate)
        return {"rate": math.exp(rng.uniform(low, high)), "depth": rng.randint(*self.depth)}

    def wide(self) -> Space:
        """These bounds stretched to those of WIDE_RATE and WIDE_DEPTH, where they don't reach further already."""
        stretch = lambda own, to: (min(own[0], to[0]), max(own[1], to[1]))
        return Space(stretch(self.rate, WIDE_RATE), stretch(self.depth, WIDE_DEPTH))


@dataclass(frozen=True)
class Found:
    """The best settings with their error, and a row for each fit setting and rung: (rung, number, rate, depth, rounds, mae)."""

    settings: dict
    mae: float
    trials: list[tuple[int, int, float, int, int, float]]
    in_time: bool = True

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.trials, "rung int, number int, rate double, depth int, rounds int, mae double")


def cv_error(parts: list[tuple[DataFrame, DataFrame]], target: str, features: list[str], seed: int, scored: Column | None = None, **settings) -> float:
    """The mean over folds of the absolute error on scored rows; of a fold without such rows, on all."""
    error = F.abs(F.col(target) - F.col("prediction"))
    error = F.avg(error) if scored is None else F.coalesce(F.avg(F.when(scored, error)), F.avg(error))
    found = [fit_predict(train, valid, features, gbt(target, seed, **settings)).agg(error).first()[0] for train, valid in parts]
    return sum(found) / len(found)


def search(
    assigned: DataFrame, target: str, features: list[str], space: Space | None = None, trials: int = 8, rounds: int = 40, rungs: int = 3, seed: int = 42, seconds: float | None = None, workers: int = 4, scored: Column | None = None
) -> Found:
    """Successive halving over ``trials`` drawn settings, the last rung with all ``rounds``; folds from folds.assign()."""
    space, rng = space or Space(), random.Random(seed)
    drawn = [space.draw(rng) for _ in range(trials)]
    assigned = stored(assigned)
    ids = [r[0] for r in assigned.select("fold_id").distinct().orderBy("fold_id").collect()]
    parts = [tuple(assigned.where((F.col("fold_id") == f) & (F.col("role") == role)) for role in ("train", "valid")) for f in ids]
    sc, tag, end = assigned.sparkSession.sparkContext, f"search-{uuid.uuid4().hex}", None if seconds is None else time.monotonic() + seconds
    alive, log, in_time = list(range(trials)), [], True
    best: tuple[float, int, int] | None = None

    def run(number: int, budget: int) -> float:
        sc.addJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", f"{tag}-{number}")
        try:
            return cv_error(parts, target, features, seed, scored, rounds=budget, **drawn[number])
        finally:
            sc.removeJobTag(tag)
            sc.setLocalProperty("spark.scheduler.pool", None)

    for rung in range(rungs):
        budget = max(1, rounds >> (rungs - 1 - rung))
        with ThreadPoolExecutor(workers) as pool:
            running = {pool.submit(inheritable_thread_target(assigned.sparkSession)(run), n, budget): n for n in alive}
            left = None if end is None or best is None else max(0.0, end - time.monotonic())  # the first rung always ends
            _, late = wait(running, timeout=left)
            if late:
                in_time = False
                for f in late:
                    f.cancel()
                sc.cancelJobsWithTag(tag)
        if not in_time:
            break
        scores = sorted((f.result(), n) for f, n in running.items())
        log += [(rung, n, drawn[n]["rate"], drawn[n]["depth"], budget, mae) for mae, n in sorted(scores, key=lambda x: x[1])]
        best = (*scores[0], budget)
        alive = sorted(n for _, n in scores[: max(1, math.ceil(len(scores) / 2))])
        if end is not None and time.monotonic() > end and rung < rungs - 1:
            in_time = False
            break
    mae, number, budget = best
    return Found(drawn[number] | {"rounds": budget if in_time else rounds}, mae, log, in_time)


def settled(found: list[dict]) -> dict:
    """One setting from those of several folds or seeds: the median of each number, whole where all are."""
    out = {}
    for k in found[0] if found else ():
        values = sorted(s[k] for s in found)
        middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
        out[k] = round(middle) if all(isinstance(v, int) for v in values) else middle
    return out


def search_by_fold(assigned: DataFrame, target: str, features: list[str], inner: dict[int, DataFrame], seconds: float | None = None, **how) -> dict:
    """search() on each fold's own inner folds, then the median of the folds' settings. ``inner``: rows of folds.assign() over each fold's training rows. What is left of
    ``seconds`` is shared evenly among the folds that are still to come."""
    began, found = time.monotonic(), []
    for i, f in enumerate(sorted(inner)):
        left = None if seconds is None else max(0.0, seconds - (time.monotonic() - began))
        if found and left == 0.0:
            break
        found.append(search(inner[f], target, features, seconds=None if left is None else left / (len(inner) - i), **how).settings)
    return settled(found)


@dataclass(frozen=True)
class Cycle:
    """What a fit is made with: features, bounds of the search and how seeds are put together."""

    features: tuple[str, ...]
    space: Space = Space()
    ensemble: str = "mean"


def retuned(cycle: Cycle, verdicts: set[str], suspects: list[str]) -> Cycle:
    """The second cycle: the seeds' median where the cross-validation is at risk, wider bounds where it failed, and no suspect features, unless none would be left."""
    kept = tuple(f for f in cycle.features if f not in set(suspects)) or cycle.features
    return Cycle(kept, cycle.space.wide() if "CV_INVALID" in verdicts else cycle.space, "median" if "CV_RISK" in verdicts else cycle.ensemble)


def run_cycle(assigned: DataFrame, key: list[str], target: str, cycle: Cycle, seeds: tuple[int, ...], **how) -> tuple[DataFrame, Found]:
    """(out-of-fold ensemble, search): settings are searched within the cycle's bounds, and its seeds put together its way."""
    from tessera.operators.metrics import seed_ensemble
    from tessera.operators.model import cv_oof

    found = search(assigned, target, list(cycle.features), cycle.space, **how)
    oof = cv_oof(assigned, key, target, list(cycle.features), seeds, **found.settings)
    return seed_ensemble(oof, [*key, "fold_id", target], "prediction", cycle.ensemble), found
