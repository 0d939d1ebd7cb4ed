"""Connected components of an edge table by alternating star contractions.

Every round is one aggregation and one equi-join over the edges; nothing is
gathered on the driver but two numbers that tell whether a round changed
anything. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written

MAX_ROUNDS = 60


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Points each neighbour of u at the smallest neighbour of u (or u itself)."""
    n = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    low = n.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    pairs = n.join(low, "a")
    if both:
        out = pairs.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component = smallest node reachable.

    Self-loops and repeated edges are allowed, rows with a null end are ignored;
    a node that only has self-loops is its own component. No edges: no rows.
    """
    # written first: what makes the edges runs once
    nodes = written(edges.where("a is not null and b is not null"), "links")
    loops = nodes.where("a = b").select("a").distinct()
    e = written(nodes.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = _mark(e)
    if last[0]:
        for _ in range(MAX_ROUNDS):
            e = written(_stars(_stars(e, True), False), "edges")
            now = _mark(e)
            if now == last:
                break
            last = now
        else:
            raise RuntimeError("components did not settle")
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    loops = loops.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return found.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
