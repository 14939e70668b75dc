"""Connected components by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.session import cut


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of each node of ``edges`` (a, b); the component is its smallest node. Null ends are ignored.

    Each step re-links neighbours to the smallest one; a step's state is one row per edge, written to the shared folder,
    and a hot node is only ever aggregated by min, never collected.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    e = cut(e, "edges")
    seen = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo <> hi").distinct()
        # small star: every smaller neighbour of a node, and the node itself, are linked to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(low, "hi")
        small = joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(low.select(F.col("m").alias("lo"), "hi"))
        e = cut(small.filter("lo <> hi").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    out = e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    return out.unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
