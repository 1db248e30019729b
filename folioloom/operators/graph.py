"""Groups of linked rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Materialises a step in the checkpoint folder, so that lineage does not grow and lost executors cost one step."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not shared and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="folioloom-"))  # a folder of this machine in local mode alone
    return df.checkpoint()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node that links reach).  Null ends and links to oneself make no group.

    Min-label hooking with a shortcut over labels: rounds follow the logarithm of the longest path.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = _cut(ends.select(F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))).alias("e")).select("e.u", "e.v").distinct())
    state = _cut(edges.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("component")))
    while True:
        lowest = edges.join(state, edges["v"] == state["node"]).groupBy("u").agg(F.min("component").alias("low"))
        seen = state.join(lowest, F.col("node") == F.col("u")).select("node", "component", F.least("component", "low").alias("low"))
        offers = seen.select("node", "low").unionByName(seen.select(F.col("component").alias("node"), "low"))
        hooked = _cut(offers.groupBy("node").agg(F.min("low").alias("low")))
        parent = hooked.select(F.col("node").alias("low"), F.col("low").alias("component"))
        after = _cut(hooked.join(parent, "low").select("node", "component"))
        if after.exceptAll(state).isEmpty():
            return after
        state = after
