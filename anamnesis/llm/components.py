"""Connected components of a table of links, by least labels and pointer jumping on Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node reachable.

    links: columns a and b. Each round takes the least label among neighbours and then the label of
    one's label, so that a round at least doubles how far labels reach along a tree. Labels are
    tables in the shared folder, not lineage. No links give no rows; nulls link nothing.
    """
    links = links.where("a <> b").select("a", "b")
    edges = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(edges.a.alias("node")).agg(F.min("root").alias("near"))
        met = materialize(labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next")), "labels")
        ahead = met.select(F.col("node").alias("up"), F.col("next").alias("top"))
        jumped = materialize(met.join(ahead, met.next == ahead.up).select("node", F.least("next", "top").alias("next"), (F.least("next", "top") < F.col("root")).alias("moved")), "labels")
        labels = jumped.select("node", F.col("next").alias("root"))
        if not jumped.where("moved").head(1):
            return labels
