"""Connected components of an edge table, as rounds of joins over written tables; no part of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.operators.tables import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node reaches. Nodes may be of any ordered type; null ends are dropped.

    Each round passes least labels to neighbours and then jumps to the label of the label, so a chain of n edges takes
    about log n rounds. Join keys are wrapped, so that both sides shuffle plainly and AQE may split a hub's edges.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = written(pairs.union(pairs.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        told = both.join(labels, F.array("a") == F.array("node")).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("told"))
        lower = labels.join(told, "node").select("node", F.least("component", "told").alias("mid"), F.col("component").alias("before"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        after = written(lower.join(jump, F.array("mid") == F.array("via"), "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("component"), "before"), "labels")
        labels = after.select("node", "component")
        if after.where("component < before").isEmpty():
            return labels


def survivors(components: DataFrame, at_most: int = 25) -> DataFrame:
    """(node, survivor) of components with at most so many nodes; a larger one is left alone, as evidence of a bad link."""
    sizes = components.groupBy("component").agg(F.count("*").alias("nodes")).where(F.col("nodes") <= at_most)
    return components.join(sizes, "component").select("node", F.col("component").alias("survivor"))
