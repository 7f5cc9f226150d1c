import re

import pytest

import corpus_pipeline
from tessera.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{i}"
        f(spark, docs[-1], DATA).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def test_stages_keep_columns_and_only_take_away(stages):
    names = stages[0].columns
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert after.columns == names and 0 < after.count() <= before.count()
        assert after.exceptAll(before).isEmpty()


def test_classifiers_decisions_take_effect(spark, stages):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages[:3]]
    bad = {k for k, r in labels.items() if r.quality == 0}
    assert len(bad & kept[1]) < 0.3 * len(bad) and len(kept[1] - bad) > 0.9 * len(kept[0] - bad)
    assert len(kept[2]) > 0.9 * len(kept[1])


def test_one_document_of_each_group_stays(stages):
    def sets(s):
        out = {}
        for r in s.collect():
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
            out[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        return out

    before, after = sets(stages[2]), sets(stages[3])
    root = {k: k for k in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(before)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(before[a] & before[b])
            if n and 100 * n >= 75 * len(before[a] | before[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert set(after) == {k for k in keys if find(k) == k}


def test_packing_holds_all_tokens_of_the_sample(stages):
    pieces = stages[5].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in stages[4].select("doc_id").collect()}
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def through(spark, docs, tmp_path):
    out = [docs]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], DATA).write.parquet(f"{tmp_path}/{i}")
        out.append(spark.read.parquet(f"{tmp_path}/{i}"))
    return out


def test_an_empty_table_goes_through(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    kept = through(spark, docs, tmp_path)
    assert [k.count() for k in kept] == [0] * 6 and all(k.columns == docs.columns for k in kept[:5])


def test_repeated_rows_nulls_and_empty_texts(spark, tmp_path):
    some = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", "web", 0), (900_001, "", "en", "web", 0)], some.schema)
    kept = through(spark, some.union(some).union(odd), tmp_path)
    assert all(k.columns == some.columns for k in kept[:5]) and kept[3].count() > 20
    texts = [r.text for r in kept[3].where("length(text) > 100").collect()]
    assert len(texts) == len(set(texts))  # one row of each text stays
    assert kept[5].count() >= kept[4].count()


def test_operators_are_registered_once_each():
    numbers = [int(k[2:].split("_")[0]) for k in queries.QUERIES]
    assert numbers == sorted(set(numbers)) and set(numbers) >= set(range(1, 11))
