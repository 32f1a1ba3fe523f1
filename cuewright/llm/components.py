"""Connected components of an undirected graph, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import stored


def smallest_reachable(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every node that has a link: the smallest node it can reach.

    Each round takes the smallest label among the neighbours and then the label of that label, so a
    chain of n nodes needs about log n rounds. Labels are written to the shared folder between
    rounds, and only the number of changes reaches the driver.
    """
    edges = links.select(F.col(a).alias("node"), F.col(b).alias("peer"))
    edges = stored(edges.unionByName(edges.select(F.col("peer").alias("node"), F.col("node").alias("peer"))).distinct(), "links")
    labels = stored(edges.groupBy("node").agg(F.least(F.min("node"), F.min("peer")).alias("component")), "labels")
    while True:
        peers = labels.select(F.col("node").alias("peer"), F.col("component").alias("theirs"))
        near = edges.join(peers, "peer").groupBy("node").agg(F.min("theirs").alias("theirs"))
        moved = labels.join(near, "node").select("node", "component", F.least("component", "theirs").alias("next"))
        onward = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        jumped = moved.join(onward, "next", "left")
        new = stored(
            jumped.select("node", F.col("component").alias("was"), F.least("next", F.coalesce("further", "next")).alias("component")), "labels"
        )
        changed = new.filter("was <> component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
