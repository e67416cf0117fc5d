"""Connected components of a link table: least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import discard, saved


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label``: the least node that is reachable, for every node of ``links(a, b)``.

    Labels never leave the cluster. Each round takes the least label of all neighbours (aggregated before
    the shuffle, so a hub is one row a task) and then the label of that label; rounds grow with the
    logarithm of the longest chain in practice. Every round is a table in the shared folder, deleted after the next.
    """
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    table = labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        fresh = saved(step.join(up, "label", "left").select("node", "old", F.coalesce(F.least("label", "up"), "label").alias("label")), "labels")
        changed = fresh.where(F.col("old") != F.col("label")).limit(1).count()
        discard(table)
        table, labels = fresh, fresh.select("node", "label")
        if not changed:
            discard(both)
            return labels
