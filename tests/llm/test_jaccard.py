import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import jaccard
from tessera.llm.text import shingle_sets

SCHEMA = "doc_id long, text string, component_id string"


def brute(docs):
    sets = {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {k: (len(sets[k]), root[k]) for k in sets}


def corpus(seed, n=260):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    passages = [" ".join(word() for _ in range(40)) for _ in range(3)]
    bases = [[word() for _ in range(rng.randint(5, 120))] for _ in range(12)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:  # a near copy, sometimes of a near copy
            t = list(rng.choice(bases))
            for _ in range(rng.randint(0, 1 + len(t) // 25)):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.2:
                bases.append(t)
            docs.append((i, " ".join(t)))
        elif kind < 0.65:
            docs.append((i, rng.choice(docs)[1] if docs else "a"))
        elif kind < 0.8:
            docs.append((i, f"{' '.join(word() for _ in range(rng.randint(0, 60)))} {rng.choice(passages)}"))
        else:
            docs.append((i, " ".join(word() for _ in range(rng.randint(0, 70)))))
    return docs


@pytest.mark.parametrize("seed,few,small,region", [(1, 512, 24, 4_000_000), (2, 3, 4, 4_000_000), (3, 3, 4, 600), (5, 3, 4, 150)])
def test_components_equal_those_of_all_pairs(spark, seed, few, small, region, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "SMALL", small)
    docs = corpus(seed)
    table = spark.createDataFrame([(k, t, "x") for k, t in docs], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(table, region=region).collect()}
    assert got == brute(docs)


def test_hot_regions_take_another_way(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 5)
    monkeypatch.setattr(jaccard, "HOT", 8)
    docs = corpus(7, 200)
    table = spark.createDataFrame([(k, t, "x") for k, t in docs], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(table, region=500).collect()}
    assert got == brute(docs)


def test_recursion_inside_a_region_equals_all_pairs(monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    docs = [(k, t) for k, t in corpus(9, 400) if (t or "").split()]
    r = jaccard.Region(shingle_sets(pa.array([t for _, t in docs])), 75)
    r.join(np.arange(len(docs)))
    expected = brute(docs)
    assert [docs[i][0] for i in r.root] == [expected[k][1] for k, _ in docs]


def test_parity_bound_never_parts_linked_sets():
    docs = [(k, t) for k, t in corpus(4, 300) if (t or "").split()]
    sets = shingle_sets(pa.array([t for _, t in docs]))
    part = jaccard.apart(np.array([len(s) for s in sets]), [np.frombuffer(jaccard.parity(s).tobytes(), np.uint8) for s in sets], 75)
    found = brute(docs)
    for i, (a, _) in enumerate(docs):
        for j, (b, _) in enumerate(docs[:i]):
            if found[a][1] == found[b][1]:
                assert part[i] == part[j]


def test_nulls_repeats_and_no_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (5, "A\tb"), (None, "a b"), (6, "a b c d e f"), (6, "a b c d e f"), (7, "x " * 50_000), (8, "x " * 70_000)]
    table = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(table).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, None), (6, 2, 6), (6, 2, 6), (7, 1, 7), (8, 1, 7)], key=str)
    kept = jaccard.representatives(table)
    assert kept.columns == table.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, None, 6, 7], key=str)
    assert jaccard.classes(table.limit(0)).collect() == []


def test_links_are_followed_over_chains(spark):
    from tessera.llm.components import components

    n = 60
    edges = [(i, i + 1) for i in range(0, n)] + [(100, 101), (101, 102), (None, 3), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100, 102: 100}


def test_a_large_region_of_near_copies_is_cut_without_all_pairs(spark):
    """Two far groups of near copies and some documents between, in one region: cells hold the groups, and few rows are left to compare."""
    from pyspark.sql import functions as F

    rng = random.Random(11)
    left = [f"a{i}" for i in range(80)]
    right = left[:36] + [f"b{i}" for i in range(44)]
    docs = []
    for i in range(3000):
        t = list(left if i % 2 else right)
        if i % 50 == 0:
            t = left[:60] + [f"c{i}x{j}" for j in range(20)]
        t[rng.randrange(len(t))] = f"z{i}"
        docs.append((i, " ".join(t)))
    held = spark.createDataFrame(docs, "doc_id long, text string")
    rows = held.select(F.lit(1).cast("long").alias("region"), "doc_id", F.lit(76).cast("long").alias("n"), F.lit(3000 * 76).cast("long").alias("weight"))
    found, stars = jaccard.cells(rows, held, 5, 75, 4000)
    by_cell = found.groupBy("region", "i", "j").count().collect()
    left_over = sum(r["count"] for r in by_cell)
    assert len(by_cell) > 1 and left_over < 4 * len(docs) and stars.count() > 2500
    assert max(r["count"] for r in by_cell) < len(docs) / 5
    table = spark.createDataFrame([(k, t, "x") for k, t in docs], SCHEMA).repartition(6)
    got = {r.doc_id: r.component_id for r in jaccard.classes(table, region=4000).collect()}
    assert got[1] == got[2999] == 1 and got[2] == got[2998] == 2 and len({got[i] for i in range(0, 3000, 50)}) == 60


def test_common_shingles_meet_across_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "OFTEN", 1)
    monkeypatch.setattr(jaccard, "SAMPLED", 1)
    docs = corpus(12, 200)
    table = spark.createDataFrame([(k, t, "x") for k, t in docs], SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(table).collect()}
    assert got == brute(docs)


def test_rows_of_a_token_fit_as_their_sizes_and_places_allow(monkeypatch):
    monkeypatch.setattr(jaccard, "NEXT", 5)
    rng = np.random.default_rng(3)
    token = np.concatenate([np.sort(rng.integers(0, 250, 700)), np.full(200, 250)])
    n = rng.integers(1, 400, 900)
    most = jaccard.largest(rng.integers(0, 1 << jaccard.PLACES, 900), n, 75)
    fits = jaccard.fitting(token, n, most)
    expected = [any(i != j and token[i] == token[j] and n[i] <= most[j] and n[j] <= most[i] for j in range(900)) for i in range(900)]
    assert fits.tolist() == expected and 50 < sum(expected) < 850
    assert jaccard.largest(np.array([0]), np.array([75]), 75)[0] == 100  # all of the smaller set are in the larger


def test_sets_that_share_a_shingle_by_chance_join_no_region(spark, monkeypatch):
    """A long text meets 60 short ones in a passage each: no pair can be linked, so no sketch and no text is moved for them. Before, its region had all of them."""
    rows: dict[str, int] = {}
    stored = jaccard.materialise

    def counted(df, name):
        out = stored(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    monkeypatch.setattr(jaccard, "FEW", 8)
    rng = random.Random(21)
    long = [f"l{i}" for i in range(3000)]
    docs = [(0, " ".join(long))]
    for i in range(1, 61):
        at = 40 * i
        docs.append((i, " ".join([f"s{i}x{j}" for j in range(rng.randint(20, 60))] + long[at : at + 24])))
    docs += [(100, " ".join(["new", *long])), (101, " ".join(f"s7x{j}" for j in range(5)))]
    table = spark.createDataFrame([(k, t, "x") for k, t in docs], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(table).collect()}
    assert got == brute(docs) and got[100][1] == 0
    assert rows["near"] < 10 and rows["held"] == 2


@pytest.mark.parametrize("wide", [0, 3])
def test_lists_too_long_to_be_held_are_let_through(spark, wide, monkeypatch):
    monkeypatch.setattr(jaccard, "WIDE", wide)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = corpus(15, 120)
        table = spark.createDataFrame([(k, t, "x") for k, t in docs], SCHEMA).repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(table).collect()}
        assert got == brute(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_of_a_group_of_near_copies_are_sent_once_a_region(spark, monkeypatch):
    """What a task can hold is not cut into blocks, whose pairs send texts again and again: before, 2672 texts for 1692 sets of regions."""
    sent = {}
    joined, stored = jaccard.joined, jaccard.materialise

    def counted(rows, *args):
        sent["texts"] = rows.count()
        return joined(rows, *args)

    def kept(df, name):
        out = stored(df, name)
        if name == "parts":
            sent["sets"] = out.count()
        return out

    monkeypatch.setattr(jaccard, "joined", counted)
    monkeypatch.setattr(jaccard, "materialise", kept)
    rng = random.Random(31)
    base = [f"b{i}" for i in range(400)]
    docs = []
    for i in range(700):
        t = list(base)
        for _ in range(rng.randint(0, 14)):
            t[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(t), "x"))
    table = spark.createDataFrame(docs, SCHEMA).repartition(3)
    assert jaccard.classes(table).count() == 700
    assert sent["sets"] > 500 and sent["texts"] <= sent["sets"]


def test_short_sets_count_for_more_where_regions_are_large(spark, monkeypatch):
    """At most SETS sets come to a task, however short they are."""
    sizes = []
    cells = jaccard.cells

    def seen(rows, *args):
        sizes.append(rows.agg({"weight": "max"}).first()[0])
        return cells(rows, *args)

    monkeypatch.setattr(jaccard, "cells", seen)
    monkeypatch.setattr(jaccard, "FEW", 8)
    monkeypatch.setattr(jaccard, "SETS", 16)
    docs = [(i, f"a b c d e f g h i j k {i}") for i in range(60)]
    table = spark.createDataFrame([(k, t, "x") for k, t in docs], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(table, region=4000).collect()}
    assert got == brute(docs) and sizes == [60 * 250]
