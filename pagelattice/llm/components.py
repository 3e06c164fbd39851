"""Connected components of a graph of edges, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, comp: the least node that each node reaches.

    Each round takes the least label among a node's neighbours, then the label of that label; labels are stored after a
    round, so that lineage stays short. Labels only fall, so that the rounds end. Rows without both ends are left out; loops and repeats do no harm; a graph
    without edges has no nodes.
    """
    both = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp")), "cc-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("least"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("comp", "least").alias("to"), F.col("comp").alias("was"))
        ahead = labels.select(F.col("node").alias("to"), F.col("comp").alias("beyond"))
        step = stored(step.join(ahead, "to", "left").select("node", F.least("to", F.coalesce("beyond", "to")).alias("comp"), "was"), "cc-labels")
        changed = step.filter("comp <> was").limit(1).count()
        labels = step.select("node", "comp")
        if not changed:
            return labels
