"""Scratch tables that end a lineage in the folder that all executors share, and tables of pixels kept by tile."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY, TILE_KEY

#: Places along a side of a tile.
TILE = 256

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; an own folder only where nothing is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-quadrille-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scenes/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- tables by tile ----------------------------------------------------------------------------------------------


def tiled_session(spark: SparkSession) -> SparkSession:
    """A session on the same catalogue that joins tables on more columns than those by which both are dealt out without
    dealing them again. Tables by tile are joined without a shuffle there; elsewhere they are only pruned."""
    made = spark.newSession()
    made.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    made.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    made.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return made


def with_tile(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """The pixels with the tile each lies in, tile_y and tile_x."""
    return pixels.withColumns({"tile_y": F.floor(F.col("y") / tile), "tile_x": F.floor(F.col("x") / tile)})


def save_by_tile(pixels: DataFrame, name: str, buckets: int, tile: int = TILE) -> DataFrame:
    """Keep pixels as the table ``name``, dealt to ``buckets`` files by scene and tile and sorted by place within them.
    Two dates kept with as many buckets are joined file by file (see tiled_session()); a condition on scene and tile
    is pushed down to the files, whose row groups hold few tiles each. A large scene is spread over all files, as its tiles are dealt one by one."""
    by = ["scene_id", *TILE_KEY]
    rows = with_tile(pixels, tile).repartition(buckets, *by)
    rows.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by, *KEY[1:]).saveAsTable(name)
    return pixels.sparkSession.table(name)
