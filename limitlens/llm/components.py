"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from limitlens.plans.reuse import materialized


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is its smallest node.

    In each round every node points to the neighbour with the smallest hash, or stays where
    its own is smaller; edges are then renamed. The random order lets a constant share of
    the nodes vanish per round, also along chains. Nothing is collected; hubs are grouped
    with partial aggregates, and joins on hubs are left to adaptive skew handling.
    Null ends and loops are ignored. No edges: no rows.
    """
    edges = materialized(
        edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = materialized(
            both.groupBy(F.col("a").alias("root"))
            .agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("near"))
            .select("root", F.least("near", F.struct(F.xxhash64("root").alias("h"), F.col("root").alias("id")))["id"].alias("to"))
        )
        labels = materialized(
            labels.join(parents, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        )
        edges = materialized(
            edges.join(parents.toDF("a", "to_a"), "a").join(parents.toDF("b", "to_b"), "b")
            .filter("to_a != to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct()
        )
    smallest = labels.groupBy("root").agg(F.min("node").alias("component"))
    return materialized(labels.join(smallest, "root").select("node", "component"))
