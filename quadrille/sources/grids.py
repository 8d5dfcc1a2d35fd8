"""Pixel tables derived from driver tables, so that every operator can be asked for by name on shared data.

A cell's land cover follows from its place, its samples from an id; see FIXTURES.md, section 4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY

WIDTH = 100
SCENE = "grid"
#: (base, factor of n) of each band by land cover 0 water, 1 vegetation, 2 built, 3 soil (fixed values).
SAMPLES = {"red": [(20, 1), (30, 1), (150, 1), (90, 1)], "green": [(40, 1), (100, 1), (145, 1), (80, 1)], "blue": [(100, 1), (25, 1), (140, 1), (65, 1)], "nir": [(2, 1), (190, 1), (120, 1), (80, 8)]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cover(y: Column, x: Column) -> Column:
    return (F.floor(y / 5) + F.floor(x / 10)) % 4


def _bands(k: Column, n: Column) -> list[Column]:
    out = []
    for band, rows in SAMPLES.items():
        c = F.lit(rows[3][0]) + n * rows[3][1]
        for i in (2, 1, 0):
            c = F.when(k == i, F.lit(rows[i][0]) + n * rows[i][1]).otherwise(c)
        out.append(c.cast("int").alias(band))
    return out


def grid_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first date, from events: pixels with red, green, blue, nir, radar intensity ``sar`` and the event type."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("value").alias("sar"))
    placed = e.withColumns({"y": F.floor(F.col("event_id") / WIDTH), "x": F.col("event_id") % WIDTH, "n": F.col("user_id") % 16})
    k = F.when(F.col("event_type") == "signup", 3).otherwise(_cover(F.col("y"), F.col("x")))
    return placed.withColumn("k", k).select(F.lit(SCENE).alias("scene_id"), "y", "x", *_bands(F.col("k"), F.col("n")), "sar", "event_type", F.col("k").cast("int").alias("k"))


def grid_t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second date, from orders: vegetation in the left half has been built over."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    placed = o.withColumns({"y": F.floor(F.col("o_orderkey") / WIDTH), "x": F.col("o_orderkey") % WIDTH, "n": F.col("o_custkey") % 16})
    base = _cover(F.col("y"), F.col("x"))
    k = F.when((base == 1) & (F.col("x") < 50), 2).otherwise(base)
    return placed.withColumn("k", k).select(F.lit(SCENE).alias("scene_id"), "y", "x", *_bands(F.col("k"), F.col("n")))


def optical(grid: DataFrame) -> DataFrame:
    return grid.select(*KEY, *SAMPLES)


def visible(grid: DataFrame) -> DataFrame:
    return grid.select(*KEY, "red", "green", "blue")


def radar(grid: DataFrame) -> DataFrame:
    return grid.select(*KEY, "sar")


#: DuckDB views of the same grids.
def _sql_bands() -> str:
    return ", ".join("CASE k " + " ".join(f"WHEN {i} THEN {b} + {f} * n" for i, (b, f) in enumerate(rows)) + f" END AS {band}" for band, rows in SAMPLES.items())


GRID_SQL = f"""
g1 AS (SELECT y, x, sar, event_type, k, {_sql_bands()} FROM (
  SELECT event_id // {WIDTH} AS y, event_id % {WIDTH} AS x, user_id % 16 AS n, value AS sar, event_type,
    CASE WHEN event_type = 'signup' THEN 3 ELSE ((event_id // {WIDTH}) // 5 + (event_id % {WIDTH}) // 10) % 4 END AS k FROM events)),
g2 AS (SELECT y, x, {_sql_bands()} FROM (
  SELECT y, x, n, CASE WHEN b = 1 AND x < 50 THEN 2 ELSE b END AS k FROM (
    SELECT o_orderkey // {WIDTH} AS y, o_orderkey % {WIDTH} AS x, o_custkey % 16 AS n, ((o_orderkey // {WIDTH}) // 5 + (o_orderkey % {WIDTH}) // 10) % 4 AS b FROM orders)))"""


def synthetic(spark: SparkSession, name: str, height: int = 512, width: int = 512, seed: int = 1) -> DataFrame:
    """Own test scenes ``coast`` (four bands), ``before``, ``after`` (visible) and ``radar``, whose samples follow
    from a pixel's number by hashing, so any executor makes any part of them."""
    px = spark.range(height * width).select(F.lit(name).alias("scene_id"), F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"), "id")
    noise = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed * 1000 + salt)), F.lit(n)).cast("int")
    y, x = F.col("y") / height, F.col("x") / width

    def bands(region: Column, values: dict[int, tuple], wide: int, names: list[str]) -> list[Column]:
        out = []
        for i, b in enumerate(names):
            c = F.lit(0)
            for r, v in values.items():
                c = F.when(region == r, F.lit(v[i])).otherwise(c)
            out.append((c + noise(i, wide)).cast("int").alias(b))
        return out

    if name == "coast":
        region = F.when(y > 0.4 + 0.12 * F.sin(x * 12), 0).when((x > 0.6) & (y < 0.7), 1).when((x > 0.2) & (y > 0.15) & (y < 0.45), 2).otherwise(3)
        return px.select(*KEY, *bands(region, {0: (16, 38, 90, 3), 1: (30, 100, 22, 190), 2: (150, 140, 135, 120), 3: (90, 80, 65, 70)}, 12, ["red", "green", "blue", "nir"]))
    if name in ("before", "after"):
        river = F.abs(y - 0.35 - 0.4 * x) < 0.035
        plot = (x > 0.15) & (x < 0.65) & (y > 0.1) & (y < 0.45) & ~river
        region = F.when(river, 0).when(plot & F.lit(name == "after"), F.when((F.floor(x * 16) + F.floor(y * 16)) % 2 == 0, 2).otherwise(3)).otherwise(1)
        return px.select(F.lit("pair").alias("scene_id"), "y", "x", *bands(region, {0: (20, 50, 110), 1: (50, 135, 40), 2: (205, 210, 215), 3: (85, 88, 90)}, 12, ["red", "green", "blue"]))
    level = F.when(x > 0.6, 3).when(x < 0.45, 60).otherwise(95)
    speckle = -F.log((noise(9, 10_000) + 1) / 10_001.0)
    return px.select(F.lit(name).alias("scene_id"), "y", "x", F.least((level * speckle).cast("int"), F.lit(255)).alias("sar"))
