"""Connected components of an undirected graph held as a table of edges, by rounds of least labels with shortcuts.

Each round takes the least label over a node's edges, then the label of that label. Tables are cut into the shared folder each
round; nothing but two counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.session import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """edges: (x, y) longs. Returns (node, label): the least node that each node of an edge reaches."""
    both = edges.where("x <> y").select("x", "y").unionByName(edges.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    pairs = checkpoint(both)
    labels = checkpoint(pairs.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")))
    while True:
        near = pairs.join(labels, pairs.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.x).select("node", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("far"))
        step = step.join(up, step.new == up.up, "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new"))
        step = checkpoint(step)
        changed = step.where("new < label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
