"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.session import stage, unstage


def _mark(e: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of `edges`; component is the smallest node id of its component.

    Edges may repeat, point either way or join a node with itself; edges with a null end are left out; an empty table gives
    an empty result. Each round is two aggregations with map-side combine and two joins (AQE splits a node that holds a
    large share of the edges); the rounds needed grow with the logarithm of the longest path. Nothing is collected but a
    count and a checksum.
    """
    raw = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes_alone = raw.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    e = stage(raw.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        old, e = e, stage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        unstage(old)
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).unionByName(nodes_alone).groupBy("node").agg(F.min("component").alias("component"))
