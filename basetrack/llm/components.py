"""Connected components of a link table, without a driver-side graph.

Labels travel along the links (each node takes the smallest label next to it,
and hands it to the node that its own old label names), then along the labels
themselves (pointer jumping), so a chain of any length closes in a logarithmic
number of rounds in practice.  The rounds end when no label changes; there is
no cap on them.  A node with very many links, and a label that very many
nodes have, are hot keys of these joins: their few rows are broadcast and the
others dealt by node as well (``hot_left_join``).  Minima are combined before
each shuffle.  Each round is written as Parquet and read again: a checkpoint
keeps the size that its plan was estimated at, and as joins multiply these
estimates, their number of digits would multiply with every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_left_join, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node named in ``links`` (columns a, b; longs).

    component is the smallest node reachable.  No links give no rows; self
    links and repeated links do no harm; links with a null end are ignored.
    """
    kept = links.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label"), F.count(F.lit(1)).alias("links"))
    labels = written(labels, "labels")
    n_nodes, n_links = labels.agg(F.count(F.lit(1)), F.coalesce(F.sum("links"), F.lit(0))).first()
    while True:
        near = labels.select(F.col("node").alias("b"), F.col("label").alias("near"), "links")
        seen = hot_left_join(both, near, "b", "links", n_links, "a").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = written(labels.join(seen, "node").select("node", "links", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels-seen")
        # hooking: the node named by the old label learns the smaller one too
        hooks = step.where("label < old").groupBy(F.col("old").alias("node")).agg(F.min("label").alias("hook"))
        step = step.join(hooks, "node", "left").select("node", "links", "old", F.least("label", "hook").alias("label"))
        # pointer jumping: a node takes the label of the node that its label names, if that has another
        named = step.groupBy(F.col("label").alias("node")).agg(F.count(F.lit(1)).alias("times"))
        up = step.where("label < node").select("node", F.col("label").alias("jump"))
        jumps = up.join(named, "node").select(F.col("node").alias("label"), "jump", "times")
        after = hot_left_join(step, jumps, "label", "times", n_nodes, "node").select("node", "links", "old", F.least("label", "jump").alias("label"))
        after = written(after, "labels")
        changed = after.where("label < old").limit(1).count()
        labels = after.select("node", "label", "links")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
