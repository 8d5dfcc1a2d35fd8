"""Exact set-similarity join of shingle sets on a prefix index: the parts that documents and lines share.

An index row says that set ``c`` of ``n`` shingles has shingle ``h`` at place ``pos`` (from 0) of its rare-first
order, for the places of its prefix. Two sets of Jaccard similarity t or more share a shingle of their prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Similarity in hundredths: 100 * intersection >= PERCENT * union.
PERCENT = 80
WORDS = 5


def overlap(n: Column, m: Column, percent: int = PERCENT) -> Column:
    """The least intersection of similar sets of n and m elements."""
    return F.ceil((n + m) * percent / F.lit(100.0 + percent) - F.lit(1e-9)).cast("int")


def passes(n: Column, i: Column, m: Column, j: Column, percent: int = PERCENT) -> Column:
    """Length and positional filters for a common shingle at places i and j."""
    lengths = (F.least(n, m) * 100 >= F.greatest(n, m) * percent)
    return lengths & (F.least(n - i, m - j) >= overlap(n, m, percent))


def suffix_passes(n: Column, i: Column, rest: Column, m: Column, j: Column, rest_m: Column, percent: int = PERCENT) -> Column:
    """Suffix filter: the common shingle parts both orders, and so do the quarters of the hashes behind it. Parts of
    unequal sizes differ in as many elements, of which similar sets may have n + m less twice their least overlap."""
    apart = F.abs(i - j)
    for k in range(4):
        a, b = (F.shiftright(x, 16 * k).bitwiseAND(F.lit(0xFFFF)) for x in (rest, rest_m))
        apart = apart + F.abs(a - b)
    return apart <= n + m - 2 * overlap(n, m, percent)


def buckets(index: DataFrame) -> DataFrame:
    """For each shingle with two different sets or more: its hub, the set that has it earliest, and the size of its
    smallest set. Minima and maxima combine before the shuffle, so no bucket meets in one task."""
    grouped = index.groupBy("h").agg(
        F.min(F.struct("pos", "c", *[k for k in index.columns if k not in ("h", "c", "pos")])).alias("hub"),
        F.min("c").alias("low"),
        F.max("c").alias("high"),
        F.min("n").alias("least"),
    )
    return grouped.filter("low <> high").select("h", F.col("hub.c").alias("hub"), "least", *[F.col(f"hub.{k}").alias(f"hub_{k}") for k in index.columns if k not in ("h", "c")])


def live(index: DataFrame, shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Index rows of shared shingles that some set in the bucket could still match, given its range of sizes."""
    rows = index.join(shared, "h")
    least = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / F.lit(100.0) - F.lit(1e-9)).cast("int"))
    return rows.filter(F.col("n") - F.col("pos") >= overlap(F.col("n"), least, percent))


def intersection(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of distinct pairs (a, b) of first keys those whose sets (c, c2, items) are similar enough, as pairs of structs
    of both keys; sets that share the first key alone are judged each by itself."""
    left, right = (sets.select(F.col("c").alias(x), F.struct("c", "c2").alias(f"of_{x}"), F.col("items").alias(f"items_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common, union = intersection("items_a", "items_b"), F.size("items_a") + F.size("items_b")
    return both.withColumn("common", common).filter(F.col("common") * 100 >= (union - F.col("common")) * percent).select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
