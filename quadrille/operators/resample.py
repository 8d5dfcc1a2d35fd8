"""Bilinear regridding (J10) as two weighted joins, one for each axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from .scenes import extents


def weights(extent: DataFrame, size: str, to: str) -> DataFrame:
    """Rows (scene_id, target, source, w) for one axis: a triangle around each target's centre, as wide as a source
    cell or, where the grid gets coarser, as a target cell; weights of a target sum to 1."""
    scale = F.col(size) / F.col(to)
    wide = F.greatest(scale, F.lit(1.0))
    t = extent.select("scene_id", F.col(size).alias("n"), scale.alias("scale"), wide.alias("wide"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(to) - 1)).alias("target"))
    t = t.withColumn("centre", (F.col("target") + 0.5) * F.col("scale"))
    low = F.greatest(F.floor(F.col("centre") - F.col("wide") + 0.5), F.lit(0))
    high = F.least(F.floor(F.col("centre") + F.col("wide") + 0.5), F.col("n")) - 1
    s = t.withColumn("source", F.explode(F.sequence(low, F.greatest(low, high))))
    s = s.withColumn("w", F.greatest(1 - F.abs(F.col("source") + 0.5 - F.col("centre")) / F.col("wide"), F.lit(0.0))).filter("w > 0")
    total = s.groupBy("scene_id", "target").agg(F.sum("w").alias("total"))
    return s.join(total, ["scene_id", "target"]).select("scene_id", "target", "source", (F.col("w") / F.col("total")).alias("w"))


def resample(df: DataFrame, target: DataFrame, values: list[str], whole: bool = False) -> DataFrame:
    """The columns ``values`` of ``df`` on a grid of as many rows and columns as ``target`` (scene_id, height, width), both
    grids beginning at 0. ``whole`` rounds the results. Scenes already of that size keep their values.

    Each axis is a join on scene and line, and a sum that combines before the shuffle.
    """
    from_to = extents(df).select("scene_id", "height", "width").join(target.select("scene_id", F.col("height").alias("to_height"), F.col("width").alias("to_width")), "scene_id")
    rows = df.select(*KEY, *values)
    for axis, size, to in (("x", "width", "to_width"), ("y", "height", "to_height")):
        w = weights(from_to, size, to).withColumnRenamed("source", axis)
        other = "y" if axis == "x" else "x"
        rows = rows.join(w, ["scene_id", axis]).groupBy("scene_id", other, "target").agg(*[F.sum(F.col(v) * F.col("w")).alias(v) for v in values]).withColumnRenamed("target", axis)
    return rows.select(*KEY, *[(F.round(v) if whole else F.col(v)).alias(v) for v in values])
