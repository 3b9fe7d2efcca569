"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``(a, b)``: the smallest node that can be reached.

    Each round takes the smallest label among the neighbours, then the label of that label, so long
    chains shorten by half. Every round is stored, and the rounds end when no label changes.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = stored(
            moved.join(far, moved["label"] == far["at"]).select("node", "old", F.least("label", "next").alias("label")), "labels"
        )
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels
