"""Connected components of an edge table, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """v, label (the least vertex of its component) for each vertex of `edges` (a, b: long).

    Every round takes the least label among a vertex and its neighbours, then the label of that
    label, so that paths halve. Labels stay tables in the shared folder; the driver sees only
    whether any changed. Minima are aggregated before they are shuffled, so a vertex with very
    many neighbours brings one row per task."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels.v == near.a).select("v", "label", F.least("label", "near").alias("least"))
        over = labels.select(F.col("v").alias("of"), F.col("label").alias("further"))
        moved = stored(least.join(over, F.col("least") == F.col("of")).select("v", F.least("least", "further").alias("new"), (F.least("least", "further") != F.col("label")).alias("changed")), f"{name}-labels")
        labels = moved.select("v", F.col("new").alias("label"))
        if moved.filter("changed").isEmpty():
            return labels
