"""Connected components of a link table, distributed.

Labels start at the smallest neighbour and shrink by hooking and pointer
jumping, so the number of rounds follows the logarithm of the longest chain.
Every step is a join or a partial minimum; no group is collected anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.store import Workspace


def connected_components(links: DataFrame, space: Workspace) -> DataFrame:
    """``links``: columns a, b (long), any order, repeats allowed.  Returns node, label (smallest node reachable)."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    edges = space.table(both, "edges")
    labels = edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label"))
    labels = space.table(labels, "labels0")
    turn = 0
    while True:
        near = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("label").alias("low"))
        seen = labels.join(near, labels.node == near.u).select("node", "label", "low")
        offers = seen.select(F.explode(F.array(
            F.struct("node", F.least("label", "low").alias("label")),
            F.struct(F.col("label").alias("node"), F.least("label", "low").alias("label")),
        )).alias("o")).select("o.node", "o.label")
        hooked = space.table(offers.groupBy("node").agg(F.min("label").alias("label")), f"hooked{turn}")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = hooked.join(up, "label").select("node", F.col("top").alias("label"))
        turn += 1
        after = space.table(jumped, f"labels{turn}")
        changed = after.join(labels.select("node", F.col("label").alias("was")), "node").where("label <> was").limit(1).count()
        space.drop(f"labels{turn - 1}", f"hooked{turn - 1}")
        labels = after
        if not changed:
            space.drop("edges")
            return labels
