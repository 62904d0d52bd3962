"""Connected parts of a graph, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsheaf.session import materialize

BROADCAST_ROWS = 1_000_000


def connected_components(links: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b): the least node that links reach.

    In each round a node takes the least label of its neighbours and then that
    label's own label, so long chains shorten quickly. Labels of up to
    ``broadcast_rows`` nodes are broadcast; more are joined by shuffling.
    """

    def looked_up(labels: DataFrame) -> DataFrame:
        return F.broadcast(labels) if few else labels

    edges = materialize(
        links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = materialize(
        edges.groupBy(F.col("a").alias("node"))
        .agg(F.min("b").alias("_least"))
        .select("node", F.least("node", "_least").alias("component"))
    )
    few = labels.count() <= broadcast_rows
    while True:
        around = edges.join(looked_up(labels.toDF("b", "component")), "b").select(
            F.col("a").alias("node"), "component", F.lit(None).cast(labels.schema["node"].dataType).alias("_before")
        )
        own = labels.select("node", "component", F.col("component").alias("_before"))
        lower = materialize(
            around.unionByName(own)
            .groupBy("node")
            .agg(F.min("component").alias("_label"), F.max("_before").alias("_before"))
        )
        onward = looked_up(lower.select(F.col("node").alias("_label"), F.col("_label").alias("_further")))
        after = materialize(
            lower.join(onward, "_label", "left").select(
                "node", "_before", F.coalesce("_further", "_label").alias("component")
            )
        )
        labels = after.select("node", "component")
        if after.where(F.col("_before") != F.col("component")).isEmpty():
            return labels
