"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved

ROUNDS = 50


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link each greater neighbour of u to the least of u and its neighbours; small star: each lesser one,
    and u. ``edges`` have a > b. Minima combine before the shuffle, and joins split hot nodes, so a node's neighbours
    never meet in one task."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    rows = both.join(least, "u")
    if large:
        made = rows.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        made = rows.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return made.filter("a <> b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """Rows (node, root) for all ends of ``pairs`` (a, b) of any type with an order; root is the component's least node.

    Each round ends in a saved table; the stars have converged when a round changes nothing, by count and checksum.
    """
    edges = pairs.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = saved(edges, "edges"), None
    for _ in range(ROUNDS):
        edges = saved(_stars(_stars(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not converge in {ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
