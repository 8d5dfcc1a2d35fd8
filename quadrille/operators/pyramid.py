"""Pyramids of pictures (S11, S12): levels of halved tiles, each made from the level below, as a table.

A level has a quarter of the pixels of the one below and the same size of tile. A tile is made from the four beneath
it, so a task holds four tiles and its own, however large the scene, and all levels together shuffle a third more than
the first. Pixels that are not there are transparent; what is transparent gives no colour to the levels above.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY
from ..sources.raster import png
from .scenes import attach
from .storage import TILE, written

BANDS = ["r", "g", "b", "a"]
#: A tile: the scene's size at its level, and red, green, blue and opacity of its pixels, row by row.
RAW = "scene_id string, level int, ty long, tx long, height long, width long, rgba binary"
#: Halvings that any scene can have: sides are under 2 to this power.
MOST_LEVELS = 40


def _side(size: int, place: int, tile: int) -> int:
    """How many rows or columns the tile at ``place`` has."""
    return min(tile, size - place * tile)


def halved(rgba: np.ndarray) -> np.ndarray:
    """Each two by two places as one, at odd ends what there is of them. Opacity is the mean, colour the mean weighted by
    opacity, halves going up."""
    h, w, _ = rgba.shape
    even = np.pad(rgba.astype(np.int64), ((0, h % 2), (0, w % 2), (0, 0)))
    four = lambda m: m.reshape(m.shape[0] // 2, 2, m.shape[1] // 2, 2, -1).sum(axis=(1, 3))
    places = four(np.pad(np.ones((h, w, 1), np.int64), ((0, h % 2), (0, w % 2), (0, 0))))
    solid = even[..., 3:]
    opacity = four(solid)
    colour = (2 * four(even[..., :3] * solid) + opacity) // np.maximum(2 * opacity, 1)
    return np.concatenate((colour, (2 * opacity + places) // (2 * places)), axis=2).astype(np.uint8)


def base(layer: DataFrame, extent: DataFrame | None = None, tile: int = TILE, few: bool | None = None) -> DataFrame:
    """Level 0: a layer's pixels (r, g, b, a) as tiles. ``extent`` has height and width of each scene, by default up to
    the last row and column that has a pixel; pixels outside of it are left out. Of a pixel that is there twice the one
    of greater samples counts. Tiles without a pixel have no row."""
    if extent is None:
        extent = layer.groupBy("scene_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    sized = attach(layer.select(*KEY, *BANDS), extent.select("scene_id", "height", "width"), few)
    inside = sized.filter("y >= 0 and x >= 0 and y < height and x < width")
    placed = inside.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})

    def run(part: pd.DataFrame) -> pd.DataFrame:
        one = part.iloc[0]
        ty, tx, height, width = (int(one[c]) for c in ("ty", "tx", "height", "width"))
        rgba = np.zeros((_side(height, ty, tile), _side(width, tx, tile), 4), np.uint8)
        part = part.sort_values(BANDS)
        rgba[part["y"].to_numpy() - ty * tile, part["x"].to_numpy() - tx * tile] = part[BANDS].to_numpy()
        return pd.DataFrame({"scene_id": [one["scene_id"]], "level": [0], "ty": [ty], "tx": [tx], "height": [height], "width": [width], "rgba": [rgba.tobytes()]})

    return placed.groupBy("scene_id", "ty", "tx").applyInPandas(run, RAW)


def above(level: DataFrame, tile: int = TILE) -> DataFrame:
    """The next level of those scenes that have more than one tile."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        one = part.iloc[0]
        height, width = int(one["height"]), int(one["width"])
        py, px = int(one["ty"]) // 2, int(one["tx"]) // 2
        whole = np.zeros((_side(height, py, 2 * tile), _side(width, px, 2 * tile), 4), np.uint8)
        for t in part.itertuples(index=False):
            h, w = _side(height, t.ty, tile), _side(width, t.tx, tile)
            y, x = (t.ty - 2 * py) * tile, (t.tx - 2 * px) * tile
            whole[y : y + h, x : x + w] = np.frombuffer(t.rgba, np.uint8).reshape(h, w, 4)
        made = halved(whole)
        return pd.DataFrame({"scene_id": [one["scene_id"]], "level": [int(one["level"]) + 1], "ty": [py], "tx": [px], "height": [(height + 1) // 2], "width": [(width + 1) // 2], "rgba": [made.tobytes()]})

    more = level.filter((F.col("height") > tile) | (F.col("width") > tile))
    return more.groupBy("scene_id", F.floor(F.col("ty") / 2).alias("py"), F.floor(F.col("tx") / 2).alias("px")).applyInPandas(run, RAW)


def levels(layer: DataFrame, extent: DataFrame | None = None, tile: int = TILE, few: bool | None = None) -> DataFrame:
    """All levels of a layer, until each scene is one tile. Each is written once and the next is made from it; the loop
    knows of a level only how large its largest scene is."""
    made = [written(base(layer, extent, tile, few), "level")]
    while True:
        top = made[-1].agg(F.max(F.greatest("height", "width"))).first()[0]
        if top is None or top <= tile:
            break
        if len(made) > MOST_LEVELS:
            raise ValueError(f"a scene has a side of over 2 to the power of {MOST_LEVELS}")
        made.append(written(above(made[-1], tile), "level"))
    every = made[0]
    for m in made[1:]:
        every = every.union(m)
    return every


def as_pixels(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows (scene_id, level, y, x, r, g, b, a) of the pixels of tiles that are not wholly transparent."""

    def run(parts):
        for part in parts:
            for t in part.itertuples(index=False):
                rgba = np.frombuffer(t.rgba, np.uint8).reshape(_side(t.height, t.ty, tile), _side(t.width, t.tx, tile), 4)
                y, x = np.nonzero(rgba[..., 3])
                seen = rgba[y, x].astype(np.int32)
                yield pd.DataFrame({"scene_id": t.scene_id, "level": t.level, "y": y + t.ty * tile, "x": x + t.tx * tile, **{b: seen[:, i] for i, b in enumerate(BANDS)}})

    return tiles.mapInPandas(run, "scene_id string, level int, y long, x long, r int, g int, b int, a int")


def write_pyramid(layer: DataFrame, path: str, name: str, extent: DataFrame | None = None, tile: int = TILE, few: bool | None = None) -> None:
    """All levels of a layer as PNG tiles, in folders by layer and level, sorted by scene and place so that a tile is
    found by the statistics of its row group. Writing a layer again replaces it."""
    side = tile

    def run(parts):
        for part in parts:
            pictures = [png(np.frombuffer(t.rgba, np.uint8).reshape(_side(t.height, t.ty, side), _side(t.width, t.tx, side), 4)) for t in part.itertuples(index=False)]
            yield part.drop(columns="rgba").assign(tile=side, png=pictures)

    made = levels(layer, extent, tile, few).mapInPandas(run, "scene_id string, level int, ty long, tx long, height long, width long, tile int, png binary")
    made.repartitionByRange("level", "scene_id", "ty", "tx").sortWithinPartitions("level", "scene_id", "ty", "tx").write.mode("overwrite").partitionBy("level").parquet(f"{path.rstrip('/')}/layer={name}")


def window(spark: SparkSession, path: str, name: str, scene: str, box: tuple[int, int, int, int], most: int) -> DataFrame:
    """The tiles that show rows y0 to y1 and columns x0 to x1 (ends exclusive, in pixels of level 0) of a scene with at most
    ``most`` pixels a side, or the topmost there are. Level, scene and places are conditions on the scan."""
    y0, x0, y1, x1 = box
    rows = spark.read.parquet(f"{path.rstrip('/')}/layer={name}").filter(F.col("scene_id") == scene)
    known = rows.filter("level = 0").select("tile").limit(1).first()
    if known is None or y1 <= y0 or x1 <= x0:
        return rows.filter("false")
    wanted = next(n for n in range(MOST_LEVELS + 1) if -(-max(y1 - y0, x1 - x0) >> n) <= most or n == MOST_LEVELS)
    level = min(wanted, rows.agg(F.max("level")).first()[0])
    span = known["tile"] << level
    return rows.filter((F.col("level") == level) & F.col("ty").between(y0 // span, (y1 - 1) // span) & F.col("tx").between(x0 // span, (x1 - 1) // span))
