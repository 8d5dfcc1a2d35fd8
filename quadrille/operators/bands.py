"""Bands of pixel tables: selection, NoData, scaling and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..schema import KEY, TILE_KEY
from .scenes import attach, band_statistics


def band(samples: str, band_map: dict[str, int], name: str, channels: int) -> Column | None:
    """The sample of a band in an array column; None for a band that the map or the scene has not."""
    at = {k.lower(): v for k, v in band_map.items()}.get(name.lower())
    return None if at is None or at >= channels else F.get(F.col(samples), at)


def named_bands(df: DataFrame, channels: int, band_map: dict[str, int], samples: str = "samples", nodata: float | None = None) -> DataFrame:
    """Pixels with a column for each of red, green, blue and, where the map has it, nir. Red falls back to the first
    channel, green and blue to red."""
    red = band(samples, band_map, "red", channels)
    red = F.get(F.col(samples), 0) if red is None else red
    got = {"red": red}
    for name in ("green", "blue"):
        one = band(samples, band_map, name, channels)
        got[name] = red if one is None else one
    nir = band(samples, band_map, "nir", channels)
    if nir is not None:
        got["nir"] = nir
    return df.select(*KEY, *[px.without(c, nodata).alias(n) for n, c in got.items()])


def band_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEY and c not in TILE_KEY]


def nir_of(df: DataFrame) -> str | None:
    return "nir" if "nir" in df.columns else None


def normalise(df: DataFrame, bands: list[str] | None = None, few: bool | None = None, one_divisor: bool = False) -> DataFrame:
    """Each band over a round number above its own greatest sample; with ``one_divisor`` over the scene's."""
    bands = bands or band_columns(df)
    peaks = df.groupBy("scene_id").agg(*[F.max(b).alias(f"peak_{b}") for b in bands])
    if one_divisor:
        top = F.greatest(*[F.col(f"peak_{b}") for b in bands]) if len(bands) > 1 else F.col(f"peak_{bands[0]}")
        peaks = peaks.select("scene_id", *[top.alias(f"peak_{b}") for b in bands])
    out = attach(df, peaks, few)
    return out.withColumns({b: px.normalised(b, F.col(f"peak_{b}")) for b in bands}).select(*df.columns)


def stretch(df: DataFrame, bands: list[str] | None = None, few: bool | None = None) -> DataFrame:
    """Bands as 0 to 255 between their 2nd and 98th percentiles. Whole-number bands are read once for all of their
    statistics."""
    bands = bands or band_columns(df)
    out = attach(df, band_statistics(df, bands, [0.02, 0.98], few)[0], few)
    return out.withColumns({b: px.stretched(b, F.col(f"{b}_q0"), F.col(f"{b}_q1"), F.col(f"low_{b}"), F.col(f"high_{b}")) for b in bands}).select(*df.columns)


def rgb_view(df: DataFrame, few: bool | None = None) -> DataFrame:
    """P5: the stretched visible bands; one band is shown as grey. NoData is stretched too unless it was set NULL."""
    have = [b for b in ("red", "green", "blue") if b in df.columns]
    shown = stretch(df.select(*KEY, *have), have, few)
    return shown.select(*KEY, *[F.col(b if b in have else have[0]).alias(b) for b in ("red", "green", "blue")])


def optical_summary(df: DataFrame, few: bool | None = None) -> DataFrame:
    """Mean brightness of the view, 0 to 255, and the number of channels."""
    mean = (F.col("red") + F.col("green") + F.col("blue")) / 3
    return rgb_view(df, few).groupBy("scene_id").agg(F.bround(F.avg(mean), 2).alias("mean_brightness"), F.lit(len(band_columns(df))).alias("channels"))
