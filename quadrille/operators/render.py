"""Layers: columns r, g, b, a of each pixel, and the picture of a scene as PNG."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..schema import KEY
from ..sources.raster import png
from .bands import rgb_view
from .neighbours import boundary
from .scenes import attach

#: Pixels above which a scene's picture is made in pieces of so many rows and columns.
PIECE = 2048


def index_layer(df: DataFrame, index: str, name: str, low: float | None = None, high: float | None = None, floor: float | None = None, few: bool | None = None) -> DataFrame:
    """P27; without ``low`` or ``high`` the scene's own extremes, missing values counting as 0."""
    rows = df.select(*KEY, F.coalesce(F.col(index), F.lit(0.0)).alias("v"))
    if low is None or high is None:
        rows = attach(rows, rows.groupBy("scene_id").agg(F.min("v").alias("low"), F.max("v").alias("high")), few)
    bounds = [F.col(n) if v is None else F.lit(float(v)) for n, v in (("low", low), ("high", high))]
    return rows.select(*KEY, *px.ramp("v", name, *bounds, floor))


def ndvi_layer(df: DataFrame, index: str = "index") -> DataFrame:
    return index_layer(df, index, "rdylgn", -0.1, 0.8, 0.05)


def ndwi_layer(df: DataFrame, index: str = "index") -> DataFrame:
    return index_layer(df, index, "blues", 0.0, 0.6, 0.05)


def mask_layer(clean: DataFrame, kind: str, alpha: int = 150) -> DataFrame:
    """P28, over a cleaned mask."""
    return boundary(clean).select(*KEY, *px.overlay(F.col("mask"), F.col("edge"), px.FILLS.get(kind, px.FILLS["water"]), alpha))


def change_layer(deltas: DataFrame, bar: DataFrame, few: bool | None = None) -> DataFrame:
    """P29, with the threshold as it is reported, rounded, and the magnitude before any cleaning."""
    rows = attach(deltas.select(*KEY, "magnitude"), bar.select("scene_id", F.bround("threshold", 4).alias("threshold")), few)
    return rows.select(*KEY, *px.change_overlay(F.col("magnitude"), F.col("threshold")))


def radar_layer(radar: DataFrame) -> DataFrame:
    return radar.select(*KEY, *px.radar_overlay(F.col("filtered")))


def view_layer(df: DataFrame, few: bool | None = None) -> DataFrame:
    """The stretched picture itself."""
    return rgb_view(df, few).select(*KEY, F.col("red").alias("r"), F.col("green").alias("g"), F.col("blue").alias("b"), F.lit(255).alias("a"))


def pictures(layer: DataFrame, piece: int = PIECE) -> DataFrame:
    """Rows (scene_id, py, px, png): a scene's pixels as PNG, in pieces of ``piece`` rows and columns, so that a task never
    holds more than one piece. Pixels that are not there are transparent."""
    placed = layer.withColumns({"py": F.floor(F.col("y") / piece), "px": F.floor(F.col("x") / piece)})

    def run(part: pd.DataFrame) -> pd.DataFrame:
        y = part["y"].to_numpy() - int(part["py"].iloc[0]) * piece
        x = part["x"].to_numpy() - int(part["px"].iloc[0]) * piece
        rgba = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 4), np.uint8)
        rgba[y, x] = part[["r", "g", "b", "a"]].to_numpy()
        return part[["scene_id", "py", "px"]].head(1).assign(png=[png(rgba)])

    return placed.groupBy("scene_id", "py", "px").applyInPandas(run, "scene_id string, py long, px long, png binary")


def write_layers(layer: DataFrame, path: str, name: str) -> None:
    """A layer's pictures as rows of a table, partitioned by the layer's name."""
    pictures(layer).withColumn("layer", F.lit(name)).write.mode("append").partitionBy("layer").parquet(path)
