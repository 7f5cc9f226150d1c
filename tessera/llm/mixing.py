"""Mixing by iterative proportional fitting: token weights raked to source, language and topic marginals. DataFrame functions only.

Documents are counted into cells (source, language, topic). Each round scales the cells' weights so that every source's
weight meets its target share, then every language's, then every topic's. Up to ``SMALL`` cells are raked as the arrays of one row, inside one
expression; more are raked by joins. A document's factor is its cell's weight by its cell's tokens.

The sample is ``fraction`` of all tokens, and no cell gives more than it has: from ``fraction`` of the weights, cells that are full are held at probability 1 and
the others raked again, until all marginals of the expected tokens meet their goals within ``CLOSE`` of the sample. A goal is the target's share of the sample; where a source, language or topic has fewer tokens
than that, its goal is all that it has, and the others of its kind share the rest by their targets. ``marginals`` gives target, goal and expected share of each value; goals that
can't be met together are a warning. A document is kept with its cell's probability by a hash of its doc_id, so the choice never depends on the order or place of rows.

Targets that are not given are the tempered shares (tokens ^ ``TEMPER``, made to add up to 1). The topic should be a column of the documents, named by the caller (``topic``); where there is none, a text's form stands in for it: ``listing``
(bars between items), ``contact`` (an @ within a word), ``figures`` (over a tenth of the characters are digits), ``shouting`` (no
lower-case ASCII letter but upper-case ones) and ``prose``.

Defined results: a null text is empty and has 0 tokens; tokens are words (``[^\\x20\\x09-\\x0D]+``). Null source, language or topic are values of their own.
Cells without tokens have the factor 1. Rows with one doc_id are kept or left together. An empty table gives an empty result. Extra columns stay;
columns named like those that are added (``topic``, ``tokens``, ``factor``, ``probability``, ``kept``) are replaced.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.joins import lookup
from tessera.llm.store import materialise

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 12
TEMPER = 0.7
FRACTION = 0.5
SMALL = 20_000  # cells that are broadcast, or raked as one row, at most
CLOSE = 1e-4
MOST = 96  # rounds within the cells' capacities


def topic_of(text: Column) -> Column:
    """The form of a text."""
    n = F.length(text)
    return (
        F.when(F.contains(text, F.lit(" | ")), "listing")
        .when(F.regexp_like(text, F.lit(r"[^\s@]@[^\s@]")), "contact")
        .when(F.length(F.translate(text, "0123456789", "")) < n * 0.9, "figures")
        .when(F.regexp_like(text, F.lit("[A-Z]")) & ~F.regexp_like(text, F.lit("[a-z]")), "shouting")
        .otherwise("prose")
    )


def words(text: Column) -> Column:
    """How many words a text has."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shares(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER) -> dict[str, DataFrame]:
    """(value, goal, has) of each dimension: target shares that add up to 1, and tokens."""
    goals = {}
    for d in DIMENSIONS:
        has = F.sum("tokens").cast("double")
        goal = cells.groupBy(d).agg(F.pow(has, temper).alias("goal"), has.alias("has"))
        if targets and d in targets:
            given = F.create_map(*[x for k, v in targets[d].items() for x in (F.lit(k), F.lit(float(v)))])
            goal = goal.select(d, F.coalesce(F.element_at(given, F.col(d)), F.lit(0.0)).alias("goal"), "has")
        goal = materialise(goal, "goals")
        every = goal.agg(F.sum("goal").alias("s")).first()["s"] or 1.0
        goals[d] = goal.select(d, (F.col("goal") / F.lit(every)).alias("goal"), "has")
    return goals


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _row(cells: DataFrame, value: str, goals: dict[str, DataFrame], goal: str) -> DataFrame:
    """The cells as one row: ``cells`` (all columns, sorted), ``e`` (their values) and, of each dimension, ``g_`` goals by value, ``m_`` the cells of each value
    and ``p_`` the value of each cell. At most SMALL cells come here."""
    out = cells.agg(F.array_sort(F.collect_list(F.struct(*cells.columns))).alias("cells"))
    for d in DIMENSIONS:
        found = goals[d].agg(F.array_sort(F.collect_list(F.struct(F.col(d).alias("v"), F.col(goal).cast("double").alias("g")))).alias(f"_{d}"))
        out = out.crossJoin(F.broadcast(found))
    at = F.sequence(F.lit(0), F.size("cells") - 1)

    def place(d: str) -> Column:
        return F.transform("cells", lambda c: F.array_position(F.col(f"v_{d}"), c[d]).cast("int") - 1)

    def members(d: str) -> Column:
        return _let(F.struct(F.col(f"p_{d}").alias("p"), at.alias("at")), lambda x: F.transform(F.sequence(F.lit(0), F.size(f"v_{d}") - 1), lambda j: F.filter(x["at"], lambda i: F.get(x["p"], i) == j)))

    out = out.where(F.size("cells") > 0).withColumns({"e": F.transform("cells", lambda c: c[value].cast("double"))} | {f"{k}_{d}": F.col(f"_{d}")[k] for d in DIMENSIONS for k in ("v", "g")})
    out = out.withColumns({f"p_{d}": place(d) for d in DIMENSIONS})
    return out.withColumns({f"m_{d}": members(d) for d in DIMENSIONS})


def _sums(e: Column, members: Column, own=None) -> Column:
    """The sum of e (or of own(i, e[i])) over each value's cells."""
    one = own or (lambda i, x: x)
    return F.transform(members, lambda m: F.aggregate(m, F.lit(0.0), lambda a, i: a + one(i, F.get(e, i))))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, temper: float = TEMPER, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells (source, lang, topic without nulls, tokens) with ``weight``, whose marginals meet the targets as far as they agree."""
    goals = {d: g.drop("has") for d, g in (known or shares(cells, targets, temper)).items()}
    sums = cells.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    total = sums["t"] or 1
    out = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    if sums["n"] <= SMALL:
        row = materialise(_row(out, "weight", goals, "goal"), "row")

        def step(e: Column, k: Column) -> Column:
            pick = lambda kind: F.when(k == 0, F.col(f"{kind}_source")).when(k == 1, F.col(f"{kind}_lang")).otherwise(F.col(f"{kind}_topic"))
            scale = F.zip_with(pick("g"), _sums(e, pick("m")), lambda g, now: F.coalesce(F.try_divide(g, now), F.lit(0.0)))
            return _let(scale, lambda s: F.zip_with(e, pick("p"), lambda x, j: x * F.get(s, j)))

        steps = F.array(*(F.lit(k) for _ in range(rounds) for k in range(3)))
        row = row.select("cells", F.aggregate(steps, F.col("e"), step).alias("e"))
        out = materialise(row.select(F.inline(F.zip_with("cells", "e", lambda c, x: c.withField("weight", x)))), "weights")
    else:
        for i in range(rounds):
            for d in DIMENSIONS:
                scale = out.groupBy(d).agg(F.sum("weight").alias("now")).join(goals[d], d).select(d, F.coalesce(F.try_divide("goal", "now"), F.lit(0.0)).alias("scale"))
                out = out.join(scale, d).withColumn("weight", F.col("weight") * F.col("scale")).drop("scale")
            if i % 2 == 1 or i == rounds - 1:
                out = materialise(out, "weights")
    return out.withColumn("weight", F.col("weight") * F.lit(float(total)))


def within(goals: dict[str, DataFrame], wanted: float) -> dict[str, DataFrame]:
    """Adds ``_<dimension>``, the tokens that each value is to give: ``wanted`` by the shares, but no more than it has; what is missing goes to the others by their shares."""
    most = [g.agg(F.sum(F.when(F.col("goal") > 0, F.col("has")))).first()[0] or 0.0 for g in goals.values()]
    wanted, out = min(wanted, *most), {}
    for d, g in goals.items():
        level, before = wanted, -1.0
        while level > before * (1 + 1e-12):
            full = F.col("has") <= F.col("goal") * F.lit(level)
            held, rest = g.agg(F.sum(F.when(full, F.col("has"))), F.sum(F.when(~full, F.col("goal")))).first()
            before, level = level, (wanted - (held or 0.0)) / rest if rest else level
        out[d] = g.withColumn(f"_{d}", F.least("has", F.col("goal") * F.lit(before)) if before > 0 else F.lit(0.0))
    return out


def fill(cells: DataFrame, goals: dict[str, DataFrame], n: int) -> DataFrame:
    """cells (source, lang, topic, tokens, expected) with ``expected`` raked to the goals, between 0 and tokens.

    A few cells are raked as one row, more by joins; both do the same.
    """
    sample = goals["source"].agg(F.sum("_source")).first()[0] or 1.0
    off = 0.0
    if n <= SMALL:
        row = materialise(_row(cells, "expected", {d: goals[d].select(d, F.col(f"_{d}").alias("goal")) for d in DIMENSIONS}, "goal").withColumn("cap", F.transform("cells", lambda c: c["tokens"].cast("double"))), "row")

        def step(state: Column, k: Column) -> Column:
            pick = lambda kind: F.when(k == 0, F.col(f"{kind}_source")).when(k == 1, F.col(f"{kind}_lang")).otherwise(F.col(f"{kind}_topic"))

            def moved(e: Column) -> Column:
                most = lambda i: F.get(F.col("cap"), i)
                held, free = _sums(e, pick("m"), lambda i, x: F.when(x >= most(i), x).otherwise(0.0)), _sums(e, pick("m"), lambda i, x: F.when(x >= most(i), 0.0).otherwise(x))
                # of each value: how much all its cells fall, or those that aren't full rise
                facts = F.zip_with(pick("g"), F.arrays_zip(held.alias("held"), free.alias("free")), lambda g, s: F.struct(
                    F.when(s["held"] + s["free"] > g, g / (s["held"] + s["free"])).alias("fall"), F.coalesce(F.try_divide(g - s["held"], s["free"]), F.lit(1.0)).alias("rise")))
                return _let(facts, lambda f: F.transform(e, lambda x, i: _let(F.get(f, F.get(pick("p"), i)), lambda v: F.when(v["fall"].isNotNull(), x * v["fall"]).when(x >= most(i), x).otherwise(F.least(most(i), x * v["rise"])))))

            def checked(e: Column) -> Column:
                gaps = F.concat(*(F.zip_with(F.col(f"g_{d}"), _sums(e, F.col(f"m_{d}")), lambda g, now: F.abs(now - g)) for d in DIMENSIONS))
                return F.struct(e.alias("e"), F.coalesce(F.array_max(gaps), F.lit(0.0)).alias("off"))

            # a step 3 asks whether all goals are met, after which nothing moves
            met = state["off"] <= F.lit(CLOSE * sample)
            return F.when(met, state).when(k == 3, checked(state["e"])).otherwise(F.struct(_let(state["e"], moved).alias("e"), state["off"].alias("off")))

        steps = F.array(*(F.lit(k) for i in range(MOST) for k in ((0, 1, 2, 3) if i % 6 == 5 else (0, 1, 2))))
        start = F.struct(F.col("e").alias("e"), F.lit(float("inf")).alias("off"))
        done = materialise(row.select("cells", F.aggregate(steps, start, step).alias("s")), "filled")
        off = (done.select("s.off").first() or [0.0])[0]
        out = done.select(F.inline(F.zip_with("cells", F.col("s.e"), lambda c, x: c.withField("expected", x))))
    else:
        out = cells
        for d in DIMENSIONS:
            out = out.join(goals[d].select(d, f"_{d}"), d)
        out = materialise(out, "filled")
        full = F.col("expected") >= F.col("tokens")
        held, free = F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("expected")))
        for i in range(MOST):
            for d in DIMENSIONS:
                out = out.join(out.groupBy(d).agg(held.alias("_held"), free.alias("_free")), d)
                now, goal, e = F.col("_held") + F.col("_free"), F.col(f"_{d}"), F.col("expected")
                more = F.when(full, F.col("tokens").cast("double")).otherwise(F.least(F.col("tokens").cast("double"), e * F.coalesce(F.try_divide(goal - F.col("_held"), F.col("_free")), F.lit(1.0))))
                out = out.withColumn("expected", F.when(now > goal, e * goal / now).otherwise(more)).drop("_held", "_free")
            out = materialise(out, "filled")
            if i % 6 == 5:
                off = max((out.groupBy(d).agg(F.abs(F.sum("expected") - F.first(f"_{d}")).alias("off")).agg(F.max("off")).first()[0] or 0.0) for d in DIMENSIONS)
                if off <= CLOSE * sample:
                    break
        out = out.drop(*(f"_{d}" for d in DIMENSIONS))
    if off > CLOSE * sample:
        warnings.warn(f"the goals of the mix don't agree: after {MOST} rounds one is off by {off / sample:.2g} of the sample", stacklevel=2)
    return out


def _keyed(docs: DataFrame, topic: str | None) -> tuple[DataFrame, dict[str, Column]]:
    text = F.coalesce("text", F.lit(""))
    named = (F.col(topic) if topic else topic_of(text)).cast("string")
    keyed = docs.withColumn("topic", named).drop("tokens", "factor", "probability", "kept").withColumn("tokens", words(text))
    # a null is told from any string by what stands before them
    return keyed, {f"_{d}": F.concat(F.when(F.col(d).isNull(), "0").otherwise("1"), F.coalesce(F.col(d).cast("string"), F.lit(""))) for d in DIMENSIONS}


def fit(keyed: DataFrame, keys: dict[str, Column], targets: dict[str, dict[str, float]] | None, fraction: float, rounds: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(cells with factor, expected, probability and rows; goals of each dimension)."""
    counted = keyed.withColumns(keys).groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    cells = materialise(counted.toDF(*DIMENSIONS, "tokens", "rows"), "cells")
    if targets:
        targets = {d: {f"1{k}": v for k, v in t.items()} for d, t in targets.items()}
    n, every = cells.agg(F.count("*"), F.sum("tokens")).first()
    goals = shares(cells, targets)
    raked = rake(cells.drop("rows"), targets, rounds, known=goals)
    goals = within(goals, fraction * (every or 0))
    start = raked.select(*DIMENSIONS, "tokens", "weight", F.least(F.col("tokens").cast("double"), F.col("weight") * F.lit(fraction)).alias("expected"))
    filled = fill(start, goals, n).join(cells.select(*DIMENSIONS, "rows"), list(DIMENSIONS))
    chance = F.coalesce(F.least(F.lit(1.0), F.try_divide("expected", "tokens")), F.lit(float(min(1.0, fraction))))
    return materialise(filled.withColumns({"factor": F.coalesce(F.try_divide("weight", "tokens"), F.lit(1.0)), "probability": chance}), "factors"), goals


def marginals(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, topic: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """dimension, value, and shares of the sample: target, goal (the target within the tokens there are) and expected."""
    cells, goals = fit(*_keyed(docs, topic), targets, fraction, rounds)
    every, out = cells.agg(F.sum("expected")).first()[0] or 1.0, None
    for d, g in goals.items():
        sample = g.agg(F.sum(f"_{d}")).first()[0] or 1.0
        value = F.when(F.startswith(d, F.lit("1")), F.substring(F.col(d), F.lit(2), F.length(d)))
        part = cells.groupBy(d).agg((F.sum("expected") / F.lit(every)).alias("expected")).join(g, d)
        part = part.select(F.lit(d).alias("dimension"), value.alias("value"), F.col("goal").alias("target"), (F.col(f"_{d}") / F.lit(sample)).alias("goal"), "expected")
        out = part if out is None else out.unionByName(part)
    return out


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, topic: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The documents with topic, tokens, factor, probability and kept."""
    return _drawn(*_keyed(docs, topic), targets, fraction, rounds)


def _drawn(keyed: DataFrame, keys: dict[str, Column], targets: dict[str, dict[str, float]] | None, fraction: float, rounds: int) -> DataFrame:
    cells, _ = fit(keyed, keys, targets, fraction, rounds)
    n, count = cells.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    facts = cells.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), "factor", "probability", "rows")
    rows = keyed.withColumns(keys)
    if n <= SMALL:
        out = rows.join(F.broadcast(facts.drop("rows")), list(keys), "left")
    else:
        out = lookup(rows, facts, list(keys), "rows", count)
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("mixing")), 11) / F.lit(float(1 << 53))
    return out.drop(*keys).withColumn("kept", draw < F.col("probability"))


def sampled(docs: DataFrame, topic: str | None = None, **options) -> DataFrame:
    """The documents that are kept, with their own columns only."""
    own = {c: f"_own_{c}" for c in docs.columns if c in ("topic", "tokens", "factor", "probability", "kept")}
    out = mixed(docs.withColumnsRenamed(own), topic=own.get(topic, topic), **options).where("kept").drop("topic", "tokens", "factor", "probability", "kept")
    return out.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, tokens, factor, probability and kept of every document. Texts are read once."""
    keyed, keys = _keyed(docs, None)
    facts = materialise(keyed.select("doc_id", "source", "lang", "topic", "tokens"), "facts")
    return _drawn(facts, keys, None, FRACTION, ROUNDS).select("doc_id", "source", "lang", "topic", "tokens", "factor", "probability", "kept")
