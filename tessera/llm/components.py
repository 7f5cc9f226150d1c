"""Connected components of an edge table, by rounds of joins in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.joins import lookup
from tessera.llm.store import materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of (a, b) rows can reach. Every round's labels are written to the shared folder.

    A round takes the smallest label of the neighbours and then the label of that label, so the rounds grow with
    the logarithm of a component's width. Edges to one of the fewer than HOT ids that more than 1 / HOT of them lead to, and ids of a component as
    large as that, get their label by broadcast and stay where they are. Nulls and loops are ignored; without edges the result is empty.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"), F.count("*").alias("degree")), "labels")
    n, ends = labels.agg(F.count("*"), F.coalesce(F.sum("degree"), F.lit(0))).first()
    while True:
        known = labels.select(F.col("id").alias("b"), "component", "degree")
        seen = lookup(both, known, ["b"], "degree", ends).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        nearer = labels.join(seen, "id").select("id", "degree", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        nearer = materialise(nearer, "labels")
        sizes = nearer.groupBy("component").agg(F.count("*").alias("ids"))
        up = nearer.select(F.col("id").alias("component"), F.col("component").alias("root")).join(sizes, "component")
        after = lookup(nearer, up, ["component"], "ids", n)
        after = materialise(after.select("id", "degree", "was", F.least("component", "root").alias("component")), "labels")
        labels = after.select("id", "component", "degree")
        if after.where("component <> was").isEmpty():
            return labels.drop("degree")
