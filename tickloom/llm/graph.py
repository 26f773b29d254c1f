"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is named by its smallest node.

    Each round maps a node to its smallest neighbour (itself included) and contracts the links; the smallest node of a
    component is never absorbed. The maps are then composed backwards. No links give no rows.
    """
    kind = dict(links.dtypes)["a"]
    edges = materialize(links.select("a", "b").filter("a <> b")
                        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps = []
    while edges.take(1):
        former = edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy("a").agg(F.min("b").alias("b"))
                           .select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "contract")
        maps.append(step)
        left = edges.join(step.select(F.col("node").alias("a"), F.col("component").alias("x")), "a")
        edges = materialize(left.join(step.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
                            .filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                            .distinct(), "links")
        discard(former)
    if not maps:
        return links.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    found = maps[-1]
    for step in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("component"), F.col("component").alias("__c"))
        found = step.join(later, "component", "left").select("node", F.coalesce("__c", "component").alias("component"))
    done = materialize(found, "components")
    for table in (*maps, edges):
        discard(table)
    return done
