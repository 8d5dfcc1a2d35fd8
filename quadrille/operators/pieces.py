"""Components' sizes and boxes without a label for each pixel (N5, A8, A9), and the tools that SQL can call (2.10).

A tile of a mask becomes a few pieces, each with its size, its box and its places on the tile's rim. Only rims meet
across seams, so what is shuffled after the tiles is a few rows a tile. The functions work on whole Arrow batches; Spark
lets those take tables, by partitions, but not rows of a lateral join, for which ``raster_frames`` is made otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..schema import KEY
from ..sources import raster
from .components import label_tile, merged
from .storage import TILE, written

#: Beyond every x, so that labels are in the order in which rows meet the components.
STRIDE = 1 << 32
PIECE = "scene_id string, label long, pixels long, ymin long, ymax long, xmin long, xmax long, rim_y array<bigint>, rim_x array<bigint>"


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """The values in stretches of so many."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, pa.int64()))


def pieces_of(y: np.ndarray, x: np.ndarray, tile: int) -> dict[str, np.ndarray | pa.Array]:
    """Pieces of one tile from the places that are set; a place may come twice."""
    y0, x0 = int(y[0]) // tile * tile, int(x[0]) // tile * tile
    m = np.zeros((tile, tile), bool)
    m[y - y0, x - x0] = True
    roots, piece = np.unique(label_tile(m)[m], return_inverse=True)
    ys, xs = np.nonzero(m)
    n = len(roots)

    def edge(at: np.ndarray, reduce: np.ufunc, start: int) -> np.ndarray:
        out = np.full(n, start, np.int64)
        reduce.at(out, piece, at)
        return out

    rim = np.flatnonzero((ys % (tile - 1 or 1) == 0) | (xs % (tile - 1 or 1) == 0))
    rim = rim[np.argsort(piece[rim], kind="stable")]
    counts = np.bincount(piece[rim], minlength=n)
    return {
        "label": (roots // tile + y0) * STRIDE + roots % tile + x0, "pixels": np.bincount(piece, minlength=n),
        "ymin": edge(ys, np.minimum, tile) + y0, "ymax": edge(ys, np.maximum, -1) + y0 + 1, "xmin": edge(xs, np.minimum, tile) + x0, "xmax": edge(xs, np.maximum, -1) + x0 + 1,
        "rim_y": _lists(ys[rim] + y0, counts), "rim_x": _lists(xs[rim] + x0, counts),
    }


@F.arrow_udtf(returnType=PIECE)
class TileComponents:
    """``tile_components(TABLE(places) PARTITION BY (scene_id, y div 256, x div 256), 256)``: the pieces of each tile.

    ``places`` has scene_id and the y and x of the pixels that are set, from 0. A partition is a tile, so at most the
    tile's pixels are held; places of two tiles in one partition are an error.
    """

    def __init__(self) -> None:
        self.scene, self.tile, self.y, self.x = None, TILE, [], []

    def eval(self, rows: pa.RecordBatch, tile: pa.Array) -> None:
        if rows.num_rows:
            self.scene, self.tile = rows.column("scene_id")[0].as_py(), int(tile[0].as_py())
            self.y.append(rows.column("y").to_numpy(zero_copy_only=False).astype(np.int64))
            self.x.append(rows.column("x").to_numpy(zero_copy_only=False).astype(np.int64))

    def terminate(self) -> Iterator[pa.Table]:
        if not self.y:
            return
        y, x = np.concatenate(self.y), np.concatenate(self.x)
        if (y // self.tile != y[0] // self.tile).any() or (x // self.tile != x[0] // self.tile).any():
            raise ValueError("tile_components wants one tile a partition: PARTITION BY (scene_id, y div tile, x div tile)")
        made = pieces_of(y, x, self.tile)
        columns = {"scene_id": pa.array([self.scene] * len(made["pixels"]), pa.string())}
        yield pa.table(columns | {k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in made.items()})


@F.arrow_udtf(returnType="scene_id string, y long, x long, samples array<double>")
class RasterPixels:
    """``raster_pixels(TABLE(files))``: a row for each pixel of the TIFF and PNG files, given by scene_id and content."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        for scene, data in zip(rows.column("scene_id").to_pylist(), rows.column("content").to_pylist(), strict=True):
            if data is None:
                continue
            a, _ = raster.decoded(data)
            h, w, c = a.shape
            flat = a.reshape(h * w, c)
            for at in range(0, h * w, raster.PIXEL_ROWS):
                cut = flat[at : at + raster.PIXEL_ROWS].astype(np.float64)
                n = np.arange(at, at + len(cut))
                samples = pa.ListArray.from_arrays(pa.array(np.arange(len(cut) + 1) * c, pa.int32()), pa.array(cut.ravel()))
                yield pa.table({"scene_id": pa.array([scene] * len(cut), pa.string()), "y": pa.array(n // w), "x": pa.array(n % w), "samples": samples})


class RasterFrames:
    """``files, LATERAL raster_frames(content)``: a row for each frame of a TIFF, without decoding it. Other contents have
    no rows."""

    @staticmethod
    def analyze(content: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(content.dataType, BinaryType):
            raise ValueError(f"raster_frames wants the content of files as binary, not {content.dataType.simpleString()}")
        return AnalyzeResult(StructType().add("frame", IntegerType()).add("width", IntegerType()).add("height", IntegerType()).add("channels", IntegerType()).add("data_type", StringType()))

    def eval(self, content: bytes | None) -> Iterator[tuple]:
        data = bytes(content or b"")
        if data[:4] in (b"II*\0", b"MM\0*"):
            for i, t in enumerate(raster.tiff_pages(data)):
                yield i, int(t[raster.WIDTH][0]), int(t[raster.HEIGHT][0]), int(t.get(raster.SAMPLES, (1,))[0]), raster._sample_type(t).newbyteorder("=").name


def register(spark: SparkSession) -> None:
    """Make the three functions known to the session's SQL."""
    spark.udtf.register("tile_components", TileComponents)
    spark.udtf.register("raster_pixels", RasterPixels)
    spark.udtf.register("raster_frames", F.udtf(RasterFrames))


def pieces(mask: DataFrame, tile: int = TILE, name: str = "mask") -> DataFrame:
    """Rows PIECE of each tile of a mask, which has every pixel or the set ones only; y, x >= 0."""
    if tile < 2:
        raise ValueError("a tile has two places a side at least")
    places = mask.filter(F.col(name)).select(*[F.col(c) if c == "scene_id" else F.col(c).cast("long").alias(c) for c in KEY])
    dealt = places.asTable().partitionBy("scene_id", F.floor(F.col("y") / tile), F.floor(F.col("x") / tile))
    return TileComponents(dealt, F.lit(tile))


def boxes(found: DataFrame, tile: int = TILE) -> DataFrame:
    """A8, A9 of whole components from their pieces: as components.sizes() of components.components() has them. ``tile`` is
    that by which the pieces were made."""
    kept = written(found, "pieces")
    rim = kept.select("scene_id", "label", F.inline(F.arrays_zip(F.col("rim_y").alias("y"), F.col("rim_x").alias("x"))).alias("y", "x"))
    last = lambda c: F.pmod(c, F.lit(tile)) == tile - 1
    down = rim.filter(last("y")).select("scene_id", (F.col("y") + 1).alias("y"), "x", F.col("label").alias("a"))
    right = rim.filter(last("x")).select("scene_id", "y", (F.col("x") + 1).alias("x"), F.col("label").alias("a"))
    met = down.union(right).join(rim.withColumnRenamed("label", "b"), KEY).select("scene_id", "a", "b")
    whole = kept.drop("rim_y", "rim_x").join(merged(met), ["scene_id", "label"], "left").withColumn("label", F.coalesce("root", "label"))
    return whole.groupBy("scene_id", "label").agg(F.sum("pixels").alias("pixels"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"), F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"))
