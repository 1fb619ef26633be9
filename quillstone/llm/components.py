"""Connected components by least labels and pointer jumping; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Stages


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node that can be reached."""
    both = stages.put(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stages.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        nearer = labels.join(seen, "node").select("node", "component", F.least("component", "m").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        new = nearer.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("component"), F.col("component").alias("before"))
        new, changed = stages.count(new, "labels", F.col("component") != F.col("before"))
        stages.drop(labels)
        labels = new.select("node", "component")
        if not changed:
            stages.drop(both)
            return labels
