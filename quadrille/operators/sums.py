"""Summed-area tables by tile: the sum over any box of a scene is four reads, whatever its size (A10).

A tile is one row with the sums over its own pixels from its corner on. What lies above and to the left of it is carried
along its edges, row of tiles by row of tiles, so no task sees more of a scene than one tile, or the edges of one row of
tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import TILE

TILES = "scene_id string, ty long, tx long, own array<double>, bottom array<double>, right array<double>"


def tile_sums(pixels: DataFrame, value: str | None = None, tile: int = TILE) -> DataFrame:
    """Rows (scene_id, ty, tx, own, bottom, right) of the tiles that have pixels: sums from the tile's first corner to
    each of its places, row after row, and their last row and column. Without ``value`` pixels are counted. Missing
    pixels and values count as zero."""
    rows = pixels.select("scene_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), (F.col(value).cast("double") if value else F.lit(1.0)).alias("v"))
    rows = rows.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(part["ty"].iloc[0]), int(part["tx"].iloc[0])
        a = np.zeros((tile, tile))
        np.add.at(a, (part["y"].to_numpy() - ty * tile, part["x"].to_numpy() - tx * tile), part["v"].fillna(0).to_numpy())
        s = a.cumsum(axis=0).cumsum(axis=1)
        return pd.DataFrame({"scene_id": [part["scene_id"].iloc[0]], "ty": [ty], "tx": [tx], "own": [s.ravel()], "bottom": [s[-1]], "right": [s[:, -1]]})

    return rows.groupBy("scene_id", "ty", "tx").applyInPandas(run, TILES)


def _spans(boxes: DataFrame, tile: int) -> DataFrame:
    """The corners of boxes (scene_id, box, ymin, ymax, xmin, xmax), ends exclusive: rows with the sign of each, the last
    place before it (y, x) and the tile that has that place."""
    corner = lambda sign, y, x: F.struct(F.lit(sign).alias("sign"), (F.col(y) - 1).cast("long").alias("y"), (F.col(x) - 1).cast("long").alias("x"))
    four = F.array(corner(1, "ymax", "xmax"), corner(-1, "ymin", "xmax"), corner(-1, "ymax", "xmin"), corner(1, "ymin", "xmin"))
    rows = boxes.select("scene_id", "box", F.inline(four))
    return rows.withColumns({"cy": F.floor(F.col("y") / tile), "cx": F.floor(F.col("x") / tile)})


def carried(tiles: DataFrame) -> DataFrame:
    """The tiles' edges with what is carried to them: rows (scene_id, ty, tx, above, left, corner), the sums over all
    tiles straight above by column, straight to the left by row, and above and to the left. Tiles without pixels that
    lie between others are made up, so that every tile up to the scene's last has a row."""
    edges = tiles.select("scene_id", "ty", "tx", "bottom", "right")
    ends = edges.groupBy("scene_id").agg(F.min("ty").alias("y0"), F.max("ty").alias("y1"), F.min("tx").alias("x0"), F.max("tx").alias("x1"))
    every = ends.select("scene_id", F.explode(F.sequence("y0", "y1")).alias("ty"), "x0", "x1").select("scene_id", "ty", F.explode(F.sequence("x0", "x1")).alias("tx"))
    full = every.join(edges, ["scene_id", "ty", "tx"], "left")

    def before(column: str, along: str):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(along)
            size = max((len(v) for v in part[column] if v is not None), default=0)
            total, corner, out, corners = np.zeros(size), 0.0, [], []
            for values, left in zip(part[column], part["left"] if column == "bottom" else [None] * len(part), strict=True):
                out.append(total.copy())
                corners.append(corner)
                total += 0 if values is None else np.asarray(values)
                corner += 0 if left is None or not len(left) else left[-1]
            made = {"scene_id": part["scene_id"], "ty": part["ty"], "tx": part["tx"]}
            return pd.DataFrame(made | ({"left": out, "bottom": list(part["bottom"])} if column == "right" else {"above": out, "left": list(part["left"]), "corner": corners}))

        return run

    key = "scene_id string, ty long, tx long"
    rows = full.groupBy("scene_id", "ty").applyInPandas(before("right", "tx"), f"{key}, left array<double>, bottom array<double>")
    return rows.groupBy("scene_id", "tx").applyInPandas(before("bottom", "ty"), f"{key}, above array<double>, left array<double>, corner double")


def box_sums(boxes: DataFrame, tiles: DataFrame, few: bool = False, tile: int = TILE) -> DataFrame:
    """(scene_id, box, total) of each box (scene_id, box, ymin, ymax, xmin, xmax), ends exclusive, within the scene: its
    four corners are read from written tiles. Corners are sent to all tiles if the boxes are few, which the caller has
    counted; else both sides are dealt by tile."""
    corners = _spans(boxes, tile)
    at = ["scene_id", "ty", "tx"]
    near = lambda d: F.broadcast(d) if few else d
    mine = corners.withColumnsRenamed({"cy": "ty", "cx": "tx"})
    inside = lambda c, size: (F.pmod(F.col(c), F.lit(size))).cast("int")
    own = tiles.select(*at, "own").join(near(mine), at).select("scene_id", "box", (F.col("sign") * F.get("own", inside("y", tile) * tile + inside("x", tile))).alias("part"))
    rest = carried(tiles).join(near(mine), at).select("scene_id", "box", (F.col("sign") * (F.coalesce(F.get("above", inside("x", tile)), F.lit(0.0)) + F.coalesce(F.get("left", inside("y", tile)), F.lit(0.0)) + F.col("corner"))).alias("part"))
    sums = own.unionByName(rest).groupBy("scene_id", "box").agg(F.sum("part").alias("total"))
    return boxes.select("scene_id", "box").join(sums, ["scene_id", "box"], "left").select("scene_id", "box", F.coalesce("total", F.lit(0.0)).alias("total"))
