"""Connected components of links between 64-bit nodes, as joins and aggregates over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsleuth.llm.tables import Kept


def connected(links: DataFrame, rounds: int | None = None) -> Kept:
    """``node`` and ``label``, the smallest node of its component, for every node of a link (``a``, ``b``).

    Every round takes the neighbours' smallest label and then the label's own
    label, so chains halve. Hot nodes are aggregated before each shuffle. With a number of ``rounds``
    labels may be those of parts of a component; one round is enough for stars.
    """
    both = Kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    edges = both.df
    labels = Kept(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    moved = True
    while moved and rounds != 0:
        known = labels.df
        near = (edges.join(known.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        lower = Kept(known.join(near, "node").select("node", "label", F.least("label", "near").alias("next")), "lower")
        jumps = lower.df.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = Kept(lower.df.join(jumps, "next").select(
            "node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "labels")
        rounds = None if rounds is None else rounds - 1
        moved = rounds != 0 and after.df.filter("moved").limit(1).count() > 0
        labels.free()
        lower.free()
        labels = after
    both.free()
    labels.df = labels.df.select("node", "label")
    return labels
