"""Connected components of an edge table by repeated smallest-label steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustwatch.session import checkpoint_dir


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes``: id. ``edges``: a, b. Returns id, component (smallest id of the component).

    Each step takes the smallest neighbouring label and then the label of that label, so the number of
    steps grows with the logarithm of the longest path; steps go on until no label changes. Labels are checkpointed to cut the lineage.
    """
    checkpoint_dir(nodes.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    lab = nodes.select("id", F.col("id").alias("component"))
    while True:
        near = both.join(lab.select(F.col("id").alias("b"), F.col("component").alias("_c")), "b").groupBy("a").agg(F.min("_c").alias("_m"))
        nxt = lab.join(near, lab["id"] == near["a"], "left").select("id", F.col("component").alias("_old"), F.least("component", F.coalesce("_m", "component")).alias("_c"))
        up = nxt.select(F.col("id").alias("_c"), F.col("_c").alias("_cc"))
        new = nxt.join(up, "_c", "left").select("id", "_old", F.least("_c", F.coalesce("_cc", "_c")).alias("component")).checkpoint()
        changed = new.filter(F.col("component") != F.col("_old")).limit(1).count()
        lab = new.drop("_old")
        if not changed:
            return lab
