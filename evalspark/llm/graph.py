"""Connected components by rounds of joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.plans.scratch import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``links`` (x, y); comp is the smallest node reachable.

    Each round gives a node the least label among its neighbours' and then that label's own label, so that long chains
    halve. Labels are written every round: a later loss of an executor costs at most one round.
    """
    both = materialise(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("comp").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("x")).select("node", "comp", F.least("comp", "near").alias("next"))
        own = stepped.select(F.col("node").alias("via"), F.col("next").alias("far"))
        best = F.least("next", "far")
        jumped = stepped.join(own, F.col("next") == F.col("via")).select("node", best.alias("comp"), (best < F.col("comp")).alias("moved"))
        last, labels = labels, materialise(jumped, "labels")
        settled = labels.where("moved").isEmpty()
        discard(last)
        if settled:
            discard(both)
            return labels.select("node", "comp")
