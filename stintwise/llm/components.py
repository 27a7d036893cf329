"""Connected components of a table of links, without bringing it to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stintwise.operators.lookup import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all ends of `links` (a, b): the smallest node reachable. Each round
    takes the smallest label among the neighbours and then the label of that label, so distances
    shrink fast; a node with any number of neighbours is only ever aggregated."""
    pairs = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    most = pairs.count()
    labels = settle(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), most)
    while True:
        near = pairs.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        seen = Observation()
        stepped = lower.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("beyond", "component")).alias("component"))
        stepped = settle(stepped.observe(seen, F.count_if(F.col("component") != F.col("was")).alias("changed")), most)
        labels = stepped.select("node", "component")
        if not seen.get["changed"]:
            return labels
