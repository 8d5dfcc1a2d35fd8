"""Masks of what a scene shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..schema import KEY
from .bands import nir_of, normalise, rgb_view
from .scenes import attach, quantiles

#: Names of grounded features by mask (fixed values).
LABELS = {"water": "Water Body", "vegetation": "Vegetated Tract", "built_up": "Built-up Structure", "salient": "Prominent Land Feature"}
SALIENT_SHARE = 0.75


def kind_of(feature: str, strict: bool = True) -> str:
    """P14 on the driver: the mask that a feature's name asks for, by substrings; see feature_kind()."""
    f = feature.lower()
    if "water" in f:
        return "water"
    if any(w in f for w in ("veg", "crop", "forest", "field", "tree")):
        return "vegetation"
    built = ("urban", "build", "struct", "construct", "road", "city", "port") + (() if strict else ("built",))
    return "built_up" if any(w in f for w in built) else "salient"


def salient(df: DataFrame, few: bool | None = None) -> DataFrame:
    """Pixels whose stretched bands differ more among themselves than in three quarters of the scene."""
    shown = rgb_view(df, few).select(*KEY, px.spread("red", "green", "blue").alias("spread"))
    bar = quantiles(shown, {"bar": "spread"}, [SALIENT_SHARE], few)
    return attach(shown, bar, few).select(*KEY, (F.col("spread") > F.col("bar_q0")).alias("mask"))


def mask(df: DataFrame, kind: str, few: bool | None = None, threshold: float | None = None) -> DataFrame:
    """scene_id, y, x and mask for every pixel of raw bands. A missing sample is outside the mask.

    ``threshold`` overrides that of the index (P31); the default changes nothing.
    """
    if kind == "salient":
        return salient(df, few)
    scaled, nir = normalise(df, few=few), nir_of(df)
    if threshold is not None and nir and kind in ("water", "vegetation"):
        index = px.difference_ratio("green", "nir") if kind == "water" else px.difference_ratio("nir", "red")
        found = index > threshold
    else:
        found = {"water": px.water, "vegetation": px.vegetation, "built_up": px.built_up}[kind]("red", "green", "blue", nir)
    return scaled.select(*KEY, F.coalesce(found, F.lit(False)).alias("mask"))
