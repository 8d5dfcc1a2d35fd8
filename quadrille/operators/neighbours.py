"""Operators on a pixel's neighbourhood (N1-N4): one shuffle deals pixels to tiles with a halo as wide as all the
steps need, and numpy works on a tile at a time.

A chain of windows over rows and columns would shuffle twice for each step, twelve times for an opening and a
closing. A tile is at most (TILE + 2 * halo)**2 rows, whatever the scene, so no task can be too large.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..schema import KEY
from .scenes import attach, extents, quantiles
from .storage import TILE, written


def _tiles(at: str, halo: int, tile: int) -> F.Column:
    """The tiles along one axis to whose core or halo a place belongs."""
    low, high = F.floor((F.col(at) - halo) / tile), F.floor((F.col(at) + halo) / tile)
    return F.sequence(low, high)


def by_tile(df: DataFrame, values: list[str], halo: int, kernel: Callable[[dict[str, np.ndarray], np.ndarray, dict], dict[str, np.ndarray]], out: str, tile: int = TILE, scene: list[str] | None = None) -> DataFrame:
    """Rows (scene_id, y, x, ...) of each tile's core, from ``kernel(arrays, there, info)``.

    ``arrays`` holds each of ``values`` (NaN or False where there is no pixel), ``there`` says where pixels are, and
    ``info`` has the place of the array's corner and the ``scene`` columns. The kernel returns arrays by column.
    """
    scene = scene or []
    spread = df.select("scene_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *values, *scene)
    spread = spread.withColumn("ty", F.explode(_tiles("y", halo, tile))).withColumn("tx", F.explode(_tiles("x", halo, tile)))
    side = tile + 2 * halo

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(part["ty"].iloc[0]), int(part["tx"].iloc[0])
        y0, x0 = ty * tile - halo, tx * tile - halo
        y, x = part["y"].to_numpy() - y0, part["x"].to_numpy() - x0
        there = np.zeros((side, side), bool)
        there[y, x] = True
        arrays = {}
        for v in values:
            column = part[v].to_numpy()
            a = np.zeros((side, side), bool) if column.dtype in (bool, object) else np.full((side, side), np.nan)
            a[y, x] = pd.Series(column).fillna(False).to_numpy(bool) if a.dtype == bool else column
            arrays[v] = a
        made = kernel(arrays, there, {"y0": y0, "x0": x0, **{c: part[c].iloc[0] for c in scene}})
        core = np.zeros((side, side), bool)
        core[halo : halo + tile, halo : halo + tile] = True
        keep = core & there & made.pop("keep", there)
        ys, xs = np.nonzero(keep)
        return pd.DataFrame({"scene_id": part["scene_id"].iloc[0], "y": ys + y0, "x": xs + x0, **{k: a[ys, xs] for k, a in made.items()}})

    return spread.groupBy("scene_id", "ty", "tx").applyInPandas(run, f"scene_id string, y long, x long, {out}")


# --- morphology --------------------------------------------------------------------------------------------------


def _shifted(m: np.ndarray) -> list[np.ndarray]:
    p = np.pad(m, 1)
    return [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]


def eroded(m: np.ndarray) -> np.ndarray:
    """Places whose four neighbours are set as well; what is outside is not."""
    return np.logical_and.reduce(_shifted(m))


def dilated(m: np.ndarray, there: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce(_shifted(m)) & there


STEPS = {"erode": lambda m, t: eroded(m), "dilate": dilated}


def morphology(df: DataFrame, steps: list[str], mask: str = "mask", tile: int = TILE) -> DataFrame:
    """Any chain of ``erode`` and ``dilate`` with the 4-neighbour cross, in one shuffle. Rows are all pixels."""

    def kernel(arrays: dict, there: np.ndarray, _: dict) -> dict:
        m = arrays[mask] & there
        for s in steps:
            m = STEPS[s](m, there)
        return {"mask": m}

    return by_tile(df, [mask], len(steps), kernel, "mask boolean", tile)


def opened(df: DataFrame, times: int = 1, tile: int = TILE) -> DataFrame:
    return morphology(df, ["erode"] * times + ["dilate"] * times, tile=tile)


def closed(df: DataFrame, times: int = 2, tile: int = TILE) -> DataFrame:
    """What is outside the scene counts as unset in the erosions too, so masks at the frame lose up to ``times``."""
    return morphology(df, ["dilate"] * times + ["erode"] * times, tile=tile)


def cleaned(df: DataFrame, closing: bool = True, tile: int = TILE) -> DataFrame:
    """Opening once, and closing twice."""
    return morphology(df, ["erode", "dilate"] + (["dilate"] * 2 + ["erode"] * 2 if closing else []), tile=tile)


def boundary(df: DataFrame, tile: int = TILE) -> DataFrame:
    """All pixels with mask and whether they are on its edge: set, with a neighbour that is not."""

    def kernel(arrays: dict, there: np.ndarray, _: dict) -> dict:
        m = arrays["mask"] & there
        return {"mask": m, "edge": m & ~eroded(m)}

    return by_tile(df, ["mask"], 1, kernel, "mask boolean, edge boolean", tile)


# --- means -------------------------------------------------------------------------------------------------------


def _mirrored(start: int, side: int, first: int, size: int) -> np.ndarray:
    """Where, in an axis that begins at ``start``, the value of each place is: outside the scene, its mirror image,
    the edge itself being repeated."""
    at = np.arange(start, start + side) - first
    turn = at % (2 * size)
    back = np.where(turn < size, turn, 2 * size - 1 - turn) + first - start
    return np.clip(back, 0, side - 1)


def _box(a: np.ndarray, k: int) -> np.ndarray:
    """Sums of k by k around each place that has them all, from a summed-area table: four reads each, whatever k is. The
    others keep 0."""
    out, r = np.zeros_like(a), k // 2
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    s[1:, 1:] = a.cumsum(axis=0).cumsum(axis=1)
    out[r : a.shape[0] - r, r : a.shape[1] - r] = s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]
    return out


def box_mean(df: DataFrame, value: str, k: int = 5, few: bool | None = None, tile: int = TILE) -> DataFrame:
    """Mean and mean square of k by k (odd) around each pixel, the scene being mirrored at its edges."""
    if k < 1 or k % 2 == 0:
        raise ValueError("the window is an odd number of pixels")
    framed = attach(df, extents(df), few)

    def kernel(arrays: dict, there: np.ndarray, info: dict) -> dict:
        v = np.nan_to_num(arrays[value])
        at = np.ix_(_mirrored(info["y0"], len(v), int(info["frame_y"]), int(info["height"])), _mirrored(info["x0"], len(v), int(info["frame_x"]), int(info["width"])))
        # Sums of values around zero keep their last digits.
        middle = v[at].mean()
        whole = v[at] - middle
        mean, square = _box(whole, k) / k**2, _box(whole**2, k) / k**2
        return {"value": v, "mean": mean + middle, "square": square + 2 * middle * mean + middle**2}

    framed = framed.withColumnsRenamed({"y0": "frame_y", "x0": "frame_x"})
    halo = 2 * (k // 2)
    # Tiles grow with the window, so that at most some 1.6 as many pixels are dealt out as there are.
    return by_tile(framed, [value], halo, kernel, "value double, mean double, square double", max(tile, 8 * halo) if tile == TILE else tile, ["frame_y", "frame_x", "height", "width"])


def lee(df: DataFrame, value: str, k: int = 5, few: bool | None = None, noise_share: float = 0.2, tile: int = TILE) -> DataFrame:
    """Each value is drawn to its neighbours' mean, the more the less they vary beyond the scene's noise."""
    around = written(box_mean(df, value, k, few, tile).withColumn("variance", F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))), "around")
    noise = quantiles(around, {"noise": "variance"}, [noise_share], few)
    weight = F.col("variance") / (F.col("variance") + F.col("noise_q0") + px.EPS)
    return attach(around, noise, few).select(*KEY, F.col("value").alias("raw"), (F.col("mean") + weight * (F.col("value") - F.col("mean"))).alias("filtered"))
