"""Expressions of one pixel: indices, masks, ramps, and the formulas of features.

Missing samples are NULL, never NaN: comparisons with NULL drop a pixel, while NaN is greater than all in Spark.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
Expr = Column | str


def _c(x: Expr) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL, which least() and greatest() alone would pass over."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def without(x: Expr, nodata: Column | float | None) -> Column:
    """Samples equal to the NoData value, and NaN, are missing."""
    value = F.when(~F.isnan(_c(x).cast("double")), _c(x))
    return value if nodata is None else F.nullif(value, nodata if isinstance(nodata, Column) else F.lit(nodata))


# --- scaling -----------------------------------------------------------------------------------------------------


def divisor(peak: Column) -> Column:
    """What a band is divided by, from its greatest valid sample; NULL where the band is all zeros."""
    return F.when(peak <= 0, None).when(peak <= 1, 1.0).when(peak <= 255, 255.0).when(peak <= 10000, 10000.0).when(peak <= 65535, 65535.0).otherwise(peak)


def normalised(x: Expr, peak: Column) -> Column:
    scaled = F.coalesce(_c(x).cast("double") / divisor(peak), F.lit(0.0))
    return F.when(_c(x).isNotNull(), clip(scaled, 0, 1))


def stretched(x: Expr, p2: Column, p98: Column, low: Column, high: Column) -> Column:
    """0 to 255 between the percentiles, or between the extremes where those are equal; cut to whole numbers."""
    v = _c(x).cast("double")
    between = lambda a, b: clip((v - a) / F.nullif(b - a, F.lit(0.0)) * 255, 0, 255).cast("int")
    return F.when(p98 > p2, between(p2, p98)).when(high > low, between(low, high)).otherwise(F.lit(0))


# --- indices -----------------------------------------------------------------------------------------------------


def difference_ratio(a: Expr, b: Expr) -> Column:
    return (_c(a) - _c(b)) / (_c(a) + _c(b) + EPS)


def ndvi(red: Expr, nir: Expr) -> Column:
    """NULL where a band is missing or negative."""
    return F.when((_c(red) >= 0) & (_c(nir) >= 0), clip(difference_ratio(nir, red), -1, 1))


def vari(red: Expr, green: Expr, blue: Expr) -> Column:
    """The visible substitute; a divisor near zero is replaced by a small positive one."""
    d = _c(green) + _c(red) - _c(blue)
    return clip((_c(green) - _c(red)) / F.when(F.abs(d) < 1e-4, 1e-4).otherwise(d), -1, 1)


def ndwi(green: Expr, nir: Expr) -> Column:
    """P8."""
    return clip(difference_ratio(green, nir), -1, 1)


def vegetation_index(red: Expr, green: Expr, blue: Expr, nir: Expr | None) -> Column:
    return vari(red, green, blue) if nir is None else ndvi(red, nir)


# --- masks -------------------------------------------------------------------------------------------------------


def water_by_ratio(red: Expr, green: Expr, blue: Expr) -> Column:
    """P9."""
    return (difference_ratio(green, red) > 0.05) & (_c(blue) > _c(red) * 1.15) & (_c(red) < 0.35)


def water(red: Expr, green: Expr, blue: Expr, nir: Expr | None) -> Column:
    """P10."""
    if nir is not None:
        return difference_ratio(green, nir) > 0.05
    return (_c(blue) > _c(red) * 1.15) & (_c(green) > _c(red) * 1.05) & (_c(red) < 0.35)


def vegetation(red: Expr, green: Expr, blue: Expr, nir: Expr | None) -> Column:
    """P11."""
    if nir is not None:
        return difference_ratio(nir, red) > 0.25
    return (2 * _c(green) - _c(red) - _c(blue) > 0.08) & (_c(green) > _c(red))


def built_up(red: Expr, green: Expr, blue: Expr, nir: Expr | None) -> Column:
    """Bright, grey and not water."""
    r, g, b = _c(red), _c(green), _c(blue)
    grey = 1 - (F.abs(r - g) + F.abs(g - b) + F.abs(b - r)) / 3
    return ((r + g + b) / 3 > 0.4) & (grey > 0.85) & ~F.coalesce(water(r, g, b, nir), F.lit(False))


def spread(*bands: Expr) -> Column:
    """Population standard deviation of a pixel's own bands."""
    cols = [_c(b).cast("double") for b in bands]
    mean = sum(cols[1:], cols[0]) / len(cols)
    return F.sqrt(sum(((c - mean) * (c - mean) for c in cols[1:]), (cols[0] - mean) * (cols[0] - mean)) / len(cols))


def feature_kind(feature: Column, strict: bool = True) -> Column:
    """Which mask a feature's name asks for. ``built_up`` holds none of the words, so it is salient unless not
    ``strict``."""
    f = F.lower(feature)
    any_of = lambda *words: F.greatest(*[F.contains(f, F.lit(w)) for w in words])
    built = ["urban", "build", "struct", "construct", "road", "city", "port"] + ([] if strict else ["built"])
    return F.when(F.contains(f, F.lit("water")), "water").when(any_of("veg", "crop", "forest", "field", "tree"), "vegetation").when(any_of(*built), "built_up").otherwise("salient")


# --- radar -------------------------------------------------------------------------------------------------------


def decibels(x: Expr) -> Column:
    """P19."""
    return clip(10 * F.log10(F.greatest(_c(x).cast("double"), F.lit(EPS))), -35, 10)


# --- features ----------------------------------------------------------------------------------------------------


def quadrant(y: Column, x: Column) -> Column:
    """P22, of a centre in shares of the scene."""
    central = (y >= 0.35) & (y <= 0.65) & (x >= 0.35) & (x <= 0.65)
    part = F.concat(F.when(y < 0.5, "North-").otherwise("South-"), F.when(x < 0.5, "West").otherwise("East"))
    return F.when(central, "Central Sector").otherwise(part)


def hectares(pixels: Column, size: Column | float) -> Column:
    """P24."""
    s = size if isinstance(size, Column) else F.lit(float(size))
    return F.bround(pixels * s * s / 10000.0, 2)


def grounding_confidence(fill: Column) -> Column:
    """In hundredths, halves up as in the SQL of the queries."""
    return F.round(F.least(0.70 + fill * 0.28, F.lit(0.98)) * 100) / 100


def change_confidence(eta: Column, fill: Column) -> Column:
    return F.bround(F.least(0.60 + eta * 0.25 + fill * 0.15, F.lit(0.98)), 2)


def fusion_confidence(db: Column) -> Column:
    return F.bround(F.least(0.80 + (db + 10.0) / 40.0, F.lit(0.98)), 2)


# --- ramps -------------------------------------------------------------------------------------------------------


#: Colours of the ramps as red, green, blue (fixed values): bare, mixed and green; lost and gained.
BARE, MIXED, GREEN = (215, 48, 39), (254, 224, 139), (26, 152, 80)
LOST, GAINED = (239, 68, 68), (34, 197, 94)


def _byte(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("int")


def ramp(v: Expr, name: str, vmin: Column, vmax: Column, floor: float | None = None) -> list[Column]:
    """Columns r, g, b, a from 0 to 255 of a value; missing values count as 0."""
    value = F.coalesce(_c(v), F.lit(0.0))
    top = F.when(vmax <= vmin, vmin + 1e-4).otherwise(vmax)
    n = clip((value - vmin) / (top - vmin), 0, 1)
    alpha = F.lit(255)
    if name == "rdylgn":
        low, up = n * 2, (n - 0.5) * 2
        r, g, b = (F.when(n < 0.5, a + low * (m - a)).otherwise(m - up * (m - z)) for a, m, z in zip(BARE, MIXED, GREEN, strict=True))
    elif name == "blues":
        r, g, b = 235 - n * 215, 245 - n * 145, 255 - n * 25
    elif name == "change":
        d = n - 0.5
        loss, gain = d < -0.05, d > 0.05
        r, g, b = (F.when(loss, x).when(gain, y).otherwise(0) for x, y in zip(LOST, GAINED, strict=True))
        a = F.when(loss | gain, clip(F.abs(d) * 2 * 255, 120, 240)).otherwise(0)
        return [_byte(c).alias(k) for k, c in zip("rgba", (r, g, b, a), strict=True)]
    elif name == "sar_plasma":
        r, g, b = n * 255, F.sin(n * math.pi) * 220, (1 - n) * 230
    else:
        r, g, b = 68 + n * 185, 1 + n * 230, 84 + (1 - n) * 180
    if floor is not None:
        alpha = F.when(value < floor, 0).otherwise(255)
    return [_byte(c).alias(k) for k, c in zip("rgba", (r, g, b, alpha), strict=True)]


#: Fill colours of grounded features (fixed values).
FILLS = {"water": (59, 130, 246), "vegetation": (34, 197, 94), "built_up": (249, 115, 22), "salient": (168, 85, 247)}


def overlay(mask: Column, edge: Column, colour: tuple[int, int, int], alpha: int = 150) -> list[Column]:
    """The fill, and brighter edges."""
    m, e = F.coalesce(mask, F.lit(False)), F.coalesce(edge, F.lit(False))
    out = [F.when(e, min(v + 40, 255)).when(m, v).otherwise(0) for v in colour] + [F.when(e, 240).when(m, alpha).otherwise(0)]
    return [c.cast("int").alias(k) for k, c in zip("rgba", out, strict=True)]


def change_overlay(magnitude: Column, threshold: Column) -> list[Column]:
    """Only what is above the threshold is painted."""
    n = clip((magnitude - threshold) / (threshold * 1.5 + EPS), 0, 1)
    above = magnitude > threshold
    out = [F.lit(239), 140 - n * 100, F.lit(0), clip(140 + n * 100, 140, 240)]
    return [F.when(above, _byte(c)).otherwise(0).alias(k) for k, c in zip("rgba", out, strict=True)]


def radar_overlay(db: Column) -> list[Column]:
    """P30."""
    n = clip((db + 30) / 30, 0, 1)
    out = [clip(n * 280 - 25, 0, 255), clip(F.sin(n * math.pi) * 230 + n * 80, 0, 255), clip((1 - n) * 200 + n * 50, 0, 255), F.lit(255)]
    return [_byte(c).alias(k) for k, c in zip("rgba", out, strict=True)]
