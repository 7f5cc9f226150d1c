"""The corpus pipeline: documents that are good and not toxic, one of each near-duplicate group, mixed and packed.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns a table that is written as
Parquet and read again. All but the last return the columns of documents. An empty table goes through all stages and has no pieces. Rows that share a doc_id
are judged one by one; of those with equal or near texts one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, mixing, packing, quality, toxicity
from tessera.llm.store import materialise, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents: that with the smallest doc_id. Documents without words are linked with nothing and stay."""
    return jaccard.representatives(docs)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics meet their target shares of tokens; one with fewer tokens than its share gives all that it has."""
    return mixing.sampled(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed token sequences."""
    return packing.pieces(docs)


STAGES = [
    ("quality classifier", good),
    ("toxicity", civil),
    ("n-gram Jaccard join", distinct),
    ("mixing sources to target weights", weighted),
    ("packing", packed),
]

#: Trained classifiers and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
    return docs
