"""Spectral indices and their statistics (P6-P9, A1-A3). Inputs have bands from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..schema import PIXEL_SIZE
from .bands import nir_of
from .scenes import quantiles, share

NO_NIR = "The scene has no near-infrared band, so greenness in the visible bands stands in for the vegetation index."
NO_NIR_WATER = "The scene has no near-infrared band, so water is told by its colour alone."


def with_index(df: DataFrame, name: str = "index") -> DataFrame:
    """The vegetation index of each pixel, or its visible substitute."""
    return df.withColumn(name, px.vegetation_index("red", "green", "blue", nir_of(df)))


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def ndvi_stats(df: DataFrame, size: float = PIXEL_SIZE, few: bool | None = None) -> DataFrame:
    """A1: statistics over valid pixels, and four classes as shares of them; zeros where none is valid."""
    rows = df.select("scene_id", px.ndvi("red", "nir").alias("v"))
    v = F.col("v")
    aggregates = [
        F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_pop(v).alias("std"), F.count(v).alias("valid"),
        _count(v > 0.5).alias("dense"), _count((v >= 0.2) & (v <= 0.5)).alias("moderate"), _count((v >= 0.05) & (v < 0.2)).alias("sparse"), _count(v < 0.05).alias("bare"),
    ]
    got = quantiles(rows, {"v": "v"}, [0.5], few, aggregates)
    number = lambda c: F.coalesce(F.bround(c, 4), F.lit(0.0))
    n = F.col("valid")
    return got.select(
        "scene_id", number("mean").alias("mean_ndvi"), number("v_q0").alias("median_ndvi"), number("low").alias("min_ndvi"), number("high").alias("max_ndvi"), number("std").alias("std_ndvi"),
        share(F.col("dense"), n).alias("dense_vegetation_pct"), share(F.col("moderate"), n).alias("moderate_vegetation_pct"), share(F.col("sparse"), n).alias("sparse_vegetation_pct"), share(F.col("bare"), n).alias("non_vegetated_pct"),
        share(F.col("dense") + F.col("moderate"), n).alias("total_vegetation_pct"), px.hectares(F.col("dense") + F.col("moderate"), size).alias("vegetation_area_hectares"),
    )


def vari_stats(df: DataFrame, size: float = PIXEL_SIZE, few: bool | None = None) -> DataFrame:
    """A2: statistics of the visible substitute; NULL where no pixel is valid."""
    rows = df.select("scene_id", px.vari("red", "green", "blue").alias("v"))
    aggregates = [F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("valid"), _count(F.col("v") > 0.15).alias("green")]
    got = quantiles(rows, {"v": "v"}, [0.5], few, aggregates)
    pct = share(F.col("green"), F.col("valid"))
    return got.select("scene_id", F.bround("mean", 4).alias("mean_index"), F.bround("v_q0", 4).alias("median_index"), F.bround("low", 4).alias("min_index"), F.bround("high", 4).alias("max_index"), pct.alias("estimated_vegetation_pct"), pct.alias("total_vegetation_pct"), px.hectares(F.col("green"), size).alias("estimated_vegetation_hectares"))


def ndwi_stats(df: DataFrame, size: float = PIXEL_SIZE) -> DataFrame:
    """A3: water as a share of all pixels, also of those without data, and the mean index of the water."""
    v = px.ndwi("green", "nir")
    wet = v > 0.05
    got = df.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), _count(wet).alias("water"), F.avg(F.when(wet, v)).alias("mean"))
    return got.select("scene_id", F.col("water").alias("water_pixel_count"), share(F.col("water"), F.col("n")).alias("water_coverage_pct"), px.hectares(F.col("water"), size).alias("water_area_hectares"), F.coalesce(F.bround("mean", 4), F.lit(0.0)).alias("mean_water_ndwi"))


def rgb_water_stats(df: DataFrame, size: float = PIXEL_SIZE) -> DataFrame:
    """A3 without near infrared."""
    got = df.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), _count(px.water_by_ratio("red", "green", "blue")).alias("water"))
    return got.select("scene_id", F.col("water").alias("water_pixel_count"), share(F.col("water"), F.col("n")).alias("water_coverage_pct"), px.hectares(F.col("water"), size).alias("water_area_hectares"))


def vegetation_stats(df: DataFrame, size: float = PIXEL_SIZE, few: bool | None = None) -> tuple[DataFrame, str | None]:
    """A1 or A2 by what bands there are, and the limitation that comes with it."""
    return (ndvi_stats(df, size, few), None) if nir_of(df) else (vari_stats(df, size, few), NO_NIR)


def water_stats(df: DataFrame, size: float = PIXEL_SIZE) -> tuple[DataFrame, str | None]:
    return (ndwi_stats(df, size), None) if nir_of(df) else (rgb_water_stats(df, size), NO_NIR_WATER)
