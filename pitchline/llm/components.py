"""Connected components by contraction.

Each round every node takes the neighbour (or itself) of least random priority, and
links move to the taken nodes; loops and repeats go. Under random priorities a fixed
part of the nodes goes in each round whatever the shape (chains too), so the rounds
grow with the logarithm of the nodes. All state is in tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long, not null);
    component is the least node."""
    edge = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = staged(edges.where("a <> b").select(*edge).distinct(), "links")
    labels = None
    for k in range(MAX_ROUNDS):
        if links.isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("p"), F.col(c).alias("node"))
        taken = both.groupBy("a").agg(F.min(key("b")).alias("least")).select(F.col("a").alias("node"), F.least("least", key("a")).getField("node").alias("to"))
        taken = staged(taken, "taken")
        a = taken.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        b = taken.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = links.join(a, "a").join(b, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        new_links = staged(moved, "links")
        release(links)
        if labels is None:
            labels = taken.withColumnRenamed("to", "label")
        else:
            step = taken.select(F.col("node").alias("label"), "to")
            new = staged(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            release(labels)
            release(taken)
            labels = new
        labels._staged_path = getattr(labels, "_staged_path", taken._staged_path)
        links = new_links
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
