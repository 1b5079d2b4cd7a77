"""Connected components of a graph of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of a link, the smallest node that can be reached from it.

    In a round every node joins its smallest neighbour, if that is smaller than itself, and
    the links are written again between what the nodes have become; a node that keeps its
    name is smaller than all its neighbours, so the nodes with links at least halve. Both
    tables are written to the shared folder in each round. Loops, repeated links and links
    with a null end are left out; without links the result is empty.
    """
    edges = links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    edges = materialize(edges.distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("near")).unionByName(
            edges.select(F.col("lo").alias("node"), F.col("hi").alias("near"))
        )
        step = both.groupBy("node").agg(F.min("near").alias("to")).select("node", F.least("node", "to").alias("to"))
        step = materialize(step, "steps")
        # one jump along the joined nodes saves rounds
        up = step.select(F.col("node").alias("to"), F.col("to").alias("top"))
        step = materialize(step.join(up, "to").select("node", F.col("top").alias("to")), "steps")
        if labels is None:
            labels = step.withColumnRenamed("to", "component")
        else:
            moved = step.select(F.col("node").alias("component"), "to")
            labels = labels.join(moved, "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            )
        labels = materialize(labels, "labels")
        low = step.select(F.col("node").alias("lo"), F.col("to").alias("x"))
        high = step.select(F.col("node").alias("hi"), F.col("to").alias("y"))
        edges = (
            edges.join(low, "lo").join(high, "hi").where("x != y")
            .select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()
        )
        edges = materialize(edges, "links")
    if labels is None:
        return edges.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return labels
