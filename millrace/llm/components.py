"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the ends of ``edges`` (a, b): the smallest node of each component.

    Every node takes the smallest label among its own and its neighbours', then its label's label, until
    nothing changes. Neighbours are merged by partial aggregation, so a node with very many of them
    is no single group; labels are written once a round. Null ends are ignored; no edges, no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        nearest = labels.join(near, "node").select("node", F.least("root", "other").alias("next"), F.col("root").alias("before"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("further"))
        moved = nearest.join(jump, "next").select("node", F.least("next", "further").alias("root"), "before")
        moved = materialise(moved, "labels")
        changed = moved.where("root < before").limit(1).count()
        labels = moved.select("node", "root")
        if not changed:
            return labels
