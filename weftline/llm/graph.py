"""Connected components by label propagation with pointer jumping, for edges of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """edges: a, b (long, not null). Rows node, label: the smallest node that it is joined with, for nodes with an edge.

    Each round a node takes the smallest label around it, then its label's label, so rounds grow with the logarithm of a
    component's width. Sums per node combine before the shuffle, so a node with most edges is no hot key. Each round
    is written to the checkpoint folder (rows: about how many labels there are, see saved). Loops and repeated edges don't matter; no edges: no rows.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", rows)
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels", rows)
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("of")).agg(F.min("label").alias("near"))
        step = labels.join(around, F.col("node") == F.col("of")).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("then"))
        step = saved(step.join(jump, F.col("next") == F.col("at"), "left").select("node", "label", F.least("next", F.coalesce("then", "next")).alias("next")), "labels", rows)
        done = step.filter("next <> label").limit(1).count() == 0
        labels = step.select("node", F.col("next").alias("label"))
        if done:
            return labels
