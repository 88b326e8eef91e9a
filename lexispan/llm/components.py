"""Connected components by minimum labels with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(links: DataFrame) -> DataFrame:
    """id and label (smallest id reachable) of every end of a link; ``links`` has a and b.

    A round takes the smallest label among neighbours and then the label of
    that label. Minima combine before the shuffle, so a hub of any size is one
    row for each task.
    """
    both = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    )
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label"))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = materialize(lower.join(jump, "label", "left").select("id", F.least("label", "next").alias("label"), "old"))
        changed = new.where(F.col("label") < F.col("old")).limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels
