"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every node on an edge (``a``, ``b``).

    Each round takes the smallest label among the neighbours and then the
    label of that label, until nothing changes. Every round is written to the
    shared folder, so a lost executor never sends the work back to the start.
    Minima combine on the map side; joins on a hub are dealt out by adaptive execution.
    """
    both = stored(
        edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges"
    )
    labels = stored(
        both.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("id"), F.least("a", "least").alias("component")
        ),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy("a")
            .agg(F.min("component").alias("near"))
            .withColumnRenamed("a", "id")
        )
        stepped = labels.join(near, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("step")
        )
        hops = labels.select(F.col("id").alias("step"), F.col("component").alias("hop"))
        rounds = stored(
            stepped.join(hops, "step").select("id", "old", F.least("step", "hop").alias("component")), "labels"
        )
        labels = rounds.select("id", "component")
        if rounds.filter("component <> old").isEmpty():
            return labels
