"""Distributed connected components: minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, spool


def components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node reachable.

    Node ids may be of any orderable type. Self-loops and null ends are ignored; no edges give no
    rows. Both sides of every join are tables read from the shared folder, so that adaptive
    execution may split a hub's rows; tables of a round go when the next is written. Labels jump to
    their label's label each round, so the number of rounds follows the logarithm of the longest
    chain. Nothing but a count of changes reaches the driver.
    """
    pairs = edges.select(F.col(left).alias("src"), F.col(right).alias("dst")).where("src <> dst")
    both = spool(pairs.union(pairs.select("dst", "src")).distinct())
    labels = spool(
        both.groupBy(F.col("src").alias("node"))
        .agg(F.min("dst").alias("least"))
        .select("node", F.least("node", "least").alias("component"))
    )
    spare = [labels]
    if labels.isEmpty():
        return labels
    while True:
        known = labels.select(F.col("node").alias("dst"), "component")
        heard = both.join(known, "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("heard"))
        step = spool(
            labels.join(heard, "node").select(
                "node", F.col("component").alias("old"), F.least("component", "heard").alias("component")
            )
        )
        target = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = spool(step.join(target, "component").select("node", "old", F.col("further").alias("component")))
        changed = moved.where("old <> component").limit(1).count()
        release(step, *spare)
        labels, spare = moved.select("node", "component"), [moved]
        if not changed:
            release(both)
            return labels
