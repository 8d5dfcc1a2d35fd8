"""Radar backscatter and its fusion with an optical scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..schema import KEY, PIXEL_SIZE
from .bands import rgb_view
from .change import aligned
from .components import components
from .features import FUSION, as_features, polygons, shaped, top_components
from .indices import _count
from .neighbours import lee, opened
from .scenes import extents, few_scenes, share
from .steps import Steps

WINDOW = 5


def filtered(df: DataFrame, value: str = "sar", k: int = WINDOW, few: bool | None = None) -> DataFrame:
    """Pixels with raw and filtered decibels. Counts are not calibrated: any of 1 or more is at least 0 dB."""
    return lee(df.select(*KEY, px.decibels(value).alias("db")), "db", k, few)


def regimes(db: Column) -> dict[str, Column]:
    """P20; from -20 to under -16 no regime is given."""
    return {"metallic": db > -6, "volume": (db >= -16) & (db <= -6), "specular": db < -20}


#: Texts of fused features (fixed values).
STRUCTURE = "Reinforced Structure / Facility"
MECHANISM = "Dihedral / Corner Double-Bounce Reflection"
CORRELATION = "High visible geometric contrast"
METHOD = "Cross-modal correlation between optical edge variance and Lee-filtered radar backscatter (dB)"


def radar_stats(df: DataFrame, k: int = WINDOW) -> DataFrame:
    """A7 over ``filtered``, which came from windows of ``k`` by ``k``."""
    db = F.col("filtered")
    r = regimes(db)
    got = df.groupBy("scene_id").agg(F.avg(db).alias("mean"), F.max(db).alias("high"), F.min(db).alias("low"), F.stddev_pop(db).alias("sd"), F.count(F.lit(1)).alias("n"), *[_count(c).alias(k) for k, c in r.items()])
    n = F.col("n")
    return got.select(
        "scene_id", F.bround("mean", 2).alias("mean_backscatter_db"), F.bround("high", 2).alias("max_backscatter_db"), F.bround("low", 2).alias("min_backscatter_db"), F.bround("sd", 2).alias("std_backscatter_db"),
        share(F.col("metallic"), n).alias("metallic_builtup_scatter_pct"), share(F.col("volume"), n).alias("vegetative_volume_scatter_pct"), share(F.col("specular"), n).alias("calm_water_specular_pct"),
        F.lit(f"Lee Adaptive Spatial Filter ({k}x{k})").alias("speckle_filter_applied"),
    )


def fusion_pixels(optical: DataFrame, radar: DataFrame, few: bool | None = None, regrid: bool = False) -> DataFrame:
    """Pixels that both have, with decibels and whether they are bright in both. With ``regrid`` a radar scene
    of another size than the optical one is brought to its grid, once filtered (J10)."""
    radar = radar.select(*KEY, F.col("filtered").alias("db"))
    bright = rgb_view(optical, few).select(*KEY, ((F.col("red") + F.col("green") + F.col("blue")) / 765.0).alias("brightness"))
    both = bright.join(aligned(radar, radar, optical, ["db"]) if regrid else radar, KEY)
    return both.select(*KEY, "db", ((F.col("db") > -7) & (F.col("brightness") > 0.35)).alias("mask"))


def fuse(optical: DataFrame, radar_raw: DataFrame, size: float = PIXEL_SIZE, few: bool | None = None, bounds: Column | None = None, steps: Steps | None = None) -> dict[str, DataFrame]:
    """``radar`` (filtered once for both uses), ``features``, ``metrics`` and ``insights`` of each scene; ``steps`` gets the
    times of its tables."""
    steps = steps or Steps()
    with steps.timed("step_sar_speckle"):
        few = few_scenes(optical) if few is None else few
        smooth = filtered(radar_raw, few=few)
    radar = steps.written(smooth, "radar", "step_sar_speckle")
    with steps.timed("step_cross_modal_fusion"):
        both = fusion_pixels(optical, radar, few, regrid=True)
    pixels = steps.written(both, "fused", "step_cross_modal_fusion")
    with steps.timed("step_cross_modal_fusion"):
        labels = components(opened(pixels.select(*KEY, "mask")))
    extent = extents(optical)
    top = top_components(labels, extent, FUSION)
    mean = labels.join(pixels.select(*KEY, "db"), KEY).groupBy("scene_id", "label").agg(F.avg("db").alias("db"))
    shapes = shaped(top.join(mean, ["scene_id", "label"]))
    properties = [F.bround("db", 2).alias("mean_sar_backscatter_db"), F.lit(MECHANISM).alias("scattering_mechanism"), F.lit(CORRELATION).alias("optical_correlation")]
    found = steps.written(as_features(shapes, polygons(labels, top, FUSION.vertices), F.format_string("fused_struct_%d", F.col("rank")), F.lit(STRUCTURE), px.fusion_confidence(F.col("db")), properties, size, bounds), "structures", "step_cross_modal_fusion")
    stats = radar_stats(radar)
    own = found.groupBy("scene_id").agg(F.count(F.lit(1)).alias("fused_structures_count"), F.bround(F.avg(F.get_json_object("properties", "$.mean_sar_backscatter_db").cast("double")), 2).alias("mean_structural_backscatter_db"))
    metrics = stats.join(own, "scene_id", "left").fillna(0, ["fused_structures_count"]).withColumn("confidence_method", F.lit(METHOD))
    return {"radar": radar, "pixels": pixels, "labels": labels, "features": found, "metrics": metrics, "insights": insights(metrics)}


def insights(metrics: DataFrame) -> DataFrame:
    """Three sentences for each scene."""
    return metrics.select(
        "scene_id",
        F.array(
            F.format_string("%s%% of the scene returns the radar strongly (over -6 dB), as steel and upright walls do.", F.col("metallic_builtup_scatter_pct")),
            F.format_string("%d clusters are bright to both sensors and so most likely structures.", F.col("fused_structures_count")),
            F.format_string("%s%% of the surface is smooth (under -20 dB), such as calm water.", F.col("calm_water_specular_pct")),
        ).alias("insights"),
    )
