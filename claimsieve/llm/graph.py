"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge; ``root`` is the smallest node id that edges reach.

    Each round gives a node the smallest label among its neighbours and then the label of that label, so the labels
    spread over twice the distance of the round before.  Every round is written to the shared folder; nothing but the
    number of changed rows reaches the driver.  Self-edges and repeated edges are harmless, null ends are dropped.
    """
    kept = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    both = materialize(kept.union(kept.select("y", "x")).distinct(), "edges")
    labels = materialize(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("to"))
        hop = labels.select(F.col("node").alias("to"), F.col("root").alias("far"))
        moved = materialize(step.join(hop, "to", "left").select("node", F.col("root").alias("was"), F.least("to", F.coalesce("far", "to")).alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.filter("was != root").isEmpty():
            return labels
