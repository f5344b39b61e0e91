"""Connected components of an edge table, by label propagation with pointer jumping.

Each round is a few joins and aggregations keyed by node; labels are written to the shared folder, so a
lost executor costs one round.  Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of orderable nodes, in any direction, with repeats.  Gives (node, root): root is the
    smallest node of the component.  Nodes without an edge to another, and null ends, do not appear; no edges give no
    rows.  A round that moves no label is the last; each other one lowers a label, so the rounds end."""
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = written(both, "links")
    labels = written(links.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("root").alias("near"))
        best = links.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        met = labels.join(best, "node").select("node", F.least("root", "near").alias("via"), F.col("root").alias("was"))
        over = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        jumped = met.join(over, "via").select("node", F.least("via", "far").alias("root"), (F.least("via", "far") < F.col("was")).alias("moved"))
        step = written(jumped, "labels")
        moved = step.where("moved").limit(1).count()
        for path in {p.rsplit("/", 1)[0] for p in labels.inputFiles()}:
            remove(labels.sparkSession, path)
        labels = step.select("node", "root")
        if not moved:
            return labels
