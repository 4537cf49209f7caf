"""Connected components by alternating star steps, shared by near copies and url aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litflow.llm.common import discard, stored


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Large-star links the larger neighbours of each node to the smallest node around it, small-star the smaller ones;
    the rounds grow with the logarithm of the component's size. A node's neighbours are never gathered: each step is a
    minimum per node, combined before the shuffle, joined back to the edges. Every round is written to the checkpoint
    folder, and the one before deleted. Edges with a null end are left out; a self-edge gives a component of one.
    """
    seen = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    now = stored(seen.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    alone = now.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    links = now.where("a <> b")
    before, last = None, None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("of")).agg(F.least(F.min("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
        small = large.join(down, F.col("a") == F.col("of"))
        links = stored(
            small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
            .unionByName(down.select(F.col("of").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        )
        if last is not None:
            discard(last)
        after, last = _sum(links), links
        if after == before:
            break
        before = after
    found = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return found.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
