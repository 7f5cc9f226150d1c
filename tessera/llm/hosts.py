"""URL filters: rules first, then trust and distrust spread over the link graph of hosts. DataFrame functions only.

A rule is a host and a path: it fits that host and its subdomains where a url's path starts with its own; the longest rule decides. For
hosts' other pages, personalised PageRank starts at the hosts of pages that a rule allows and follows links, and distrust starts at those that
a rule blocks and follows links backwards. Links are absolute hrefs and srcs between different hosts, counted; besides, every host and
the domain above it (of two labels at least) are linked both ways with the weight ``KIN``, so that a domain's hosts share a fate where no links tell.
Ranks grow round by round, until the terms to come are known from the last three to within ``CLOSE`` of all ranks, and are made to add up to 1 of each kind, which is the same as walks that begin anew at the seeds from hosts without links. A host is blocked if its distrust exceeds ``SHARE`` of trust and distrust together. A host that neither reaches is allowed.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and is allowed. Null html has no links. Rows with the same page_id
are judged one by one. An empty table gives an empty result. Other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.joins import HOT, lookup
from tessera.llm.store import materialise

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
DAMPING = 0.85
ROUNDS = 48
CLOSE = 1e-3
SHARE = 0.5
KIN = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(url)), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, _, rest = rule.partition("/")
        fits.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, w): how many links lead from host to other host; pages: host, html."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"), F.lit(1))
    out = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    return out.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def kin(hosts: DataFrame, weight: float = KIN) -> DataFrame:
    """(src, dst, w) between each host and the domain above it, and on upwards, both ways."""
    parts = F.split("host", r"\.")
    chain = F.expr("transform(sequence(1, size(p) - 1), i -> array_join(slice(p, i, size(p)), '.'))")
    steps = hosts.select(parts.alias("p")).where("size(p) > 2").select(chain.alias("c"))
    steps = steps.select(F.explode(F.expr("transform(sequence(0, size(c) - 2), i -> struct(c[i] as src, c[i + 1] as dst))")).alias("s")).select("s.src", "s.dst").distinct()
    return steps.union(steps.select("dst", "src")).select("src", "dst", F.lit(weight).alias("w"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """(kind, host, rank): personalised PageRank per kind. edges: kind, src, dst, w; seeds: kind, host, seed (adding up to 1 per kind).

    A rank is the sum of terms, one a round: what has come along so many links. Once every other term is the one before it times the same number, the
    rest of the sum is known. ``term``, ``odd`` and ``even`` are the last three terms, newest first.
    The fewer than HOT hosts that have more than 1 / HOT of the links each send their term by broadcast, so their links stay where they are.
    """
    edges = materialise(edges, "edges")
    out = materialise(edges.groupBy("kind", "src").agg(F.sum("w").alias("all"), F.count("*").alias("links")), "out")
    least = (out.agg(F.sum("links")).first()[0] or 0) // HOT
    shares = lookup(edges, out, ["kind", "src"], "links", least * HOT)
    hubs = out.where(F.col("links") > least).select("kind", "src", F.lit(True).alias("hub"))
    moves = shares.join(F.broadcast(hubs), ["kind", "src"], "left").select("kind", "src", "dst", (F.col("w") / F.col("all") * damping).alias("p"), F.coalesce("hub", F.lit(False)).alias("hub"))
    moves = materialise(moves, "moves")
    zero = F.lit(0.0)
    state = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"), (F.col("seed") * (1 - damping)).alias("term"), zero.alias("odd"), zero.alias("even"))
    state, factors = materialise(state, "rank"), {}
    for i in range(rounds):
        now = state.where("term > 0").select("kind", F.col("host").alias("src"), "term")
        if least:
            few = F.broadcast(now.join(F.broadcast(hubs.drop("hub")), ["kind", "src"]))
            reached = moves.where("hub").join(few, ["kind", "src"]).unionByName(moves.where("not hub").join(now, ["kind", "src"]))
        else:  # fewer than HOT links: every host is a hub, and there are fewer than HOT of them
            reached = moves.join(F.broadcast(now), ["kind", "src"])
        new = (F.col("p") * F.col("term")).alias("term")
        step = reached.select("kind", F.col("dst").alias("host"), new).select("kind", "host", F.col("term").alias("rank"), "term", zero.alias("odd"), zero.alias("even"))
        kept = state.select("kind", "host", "rank", zero.alias("term"), F.col("term").alias("odd"), F.col("odd").alias("even"))
        state = step.union(kept).groupBy("kind", "host").agg(*(F.sum(c).alias(c) for c in ("rank", "term", "odd", "even")))
        state = materialise(state, "rank")  # a round reads the last one three times
        if i % 4 == 3 or i == rounds - 1:
            factors, missing = _rest(state, damping)
            if missing <= close:
                break
    factor = F.coalesce(*(F.when(F.col("kind") == k, F.lit(f / (1 - f))) for k, f in factors.items()), zero) if factors else zero
    rank = state.select("kind", "host", (F.col("rank") + (F.col("term") + F.col("odd")) * factor).alias("rank"))
    total = rank.groupBy("kind").agg(F.sum("rank").alias("all"))
    return rank.join(F.broadcast(total), "kind").select("kind", "host", (F.col("rank") / F.col("all")).alias("rank"))


def _rest(state: DataFrame, damping: float) -> tuple[dict[str, float], float]:
    """({kind: by what every other term shrinks}, bound of what the ranks are off by if terms go on so, as a share of all ranks).

    With E the newest term less that factor times the one two before, terms to come differ from the guess by at most |E| d^2 (1 + d) / ((1 - d^2) (1 - factor)), as a round
    takes no more than d of a vector's size along.
    """
    sums = {r["kind"]: r for r in state.groupBy("kind").agg(F.sum("rank").alias("rank"), F.sum("term").alias("term"), F.sum("even").alias("even")).collect()}
    factors = {k: min(damping**2, r["term"] / r["even"]) if r["even"] else 0.0 for k, r in sums.items()}
    if not factors:
        return {}, 0.0
    own = F.coalesce(*(F.when(F.col("kind") == k, F.lit(f)) for k, f in factors.items()))
    off = {r["kind"]: r["e"] for r in state.groupBy("kind").agg(F.sum(F.abs(F.col("term") - own * F.col("even"))).alias("e")).collect()}
    bound = damping**2 * (1 + damping) / (1 - damping**2)
    return factors, max(off[k] * bound / (1 - f) / sums[k]["rank"] for k, f in factors.items())


def judged(pages: DataFrame, rules: dict[str, str] | None = None, share: float = SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, of every page."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()), F.lit(None).cast("string"))
    own = own.withColumn("said", said)
    hosts = own.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("said") == "allow").alias("allow"), F.count_if(F.col("said") == "block").alias("block"))
    hosts = materialise(hosts, "hosts")
    sums = hosts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "allow", "block"))).first()
    seeds = hosts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), (F.col(k) / F.lit(max(1, sums[k]))).alias("seed")) for k in ("allow", "block")))).alias("s"), "host")
    seeds = seeds.select("s.kind", "host", "s.seed").where("seed > 0")
    edges = links(pages.select(host.alias("host"), "html")).union(kin(hosts))
    edges = edges.select(F.lit("allow").alias("kind"), "src", "dst", "w").union(edges.select(F.lit("block"), "dst", "src", "w"))
    ranks = spread(edges, seeds)
    both = ranks.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(n) for k, n in (("allow", "trust"), ("block", "distrust"))))
    facts = materialise(hosts.select("host", "pages").join(both, "host", "left"), "facts")
    out = lookup(own, facts, ["host"], "pages", sums["pages"])
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    verdict = F.coalesce("said", F.when(distrust > (trust + distrust) * share, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
