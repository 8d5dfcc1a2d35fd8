"""Tools that SQL can call, against their DataFrame forms."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_sources import tiff

from quadrille.operators import pieces
from quadrille.operators.components import components, sizes
from quadrille.sources import raster

BOXES = "SELECT scene_id, label, pixels, ymin, ymax, xmin, xmax FROM tile_components(TABLE(places) PARTITION BY (scene_id, y div {t}, x div {t}), {t})"


@pytest.fixture(scope="module")
def mask(spark):
    """Two scenes, one with a spiral that crosses many seams and one of noise; rows come twice."""
    g = np.random.default_rng(3)
    a = np.zeros((30, 30), bool)
    for k in range(0, 15, 2):
        a[k, k : 30 - k] = a[29 - k, k : 30 - k] = a[k : 30 - k, 29 - k] = True
        a[k + 2 : 30 - k, k] = True
        if k:
            a[k, k - 2 : k] = True
    b = g.random((23, 41)) < 0.55
    rows = [(n, int(y), int(x), bool(m[y, x]), "clash") for n, m in (("a", a), ("b", b)) for y in range(m.shape[0]) for x in range(m.shape[1])]
    df = spark.createDataFrame(rows, "scene_id string, y int, x int, mask boolean, label string")
    df = df.union(df.filter("x < 5"))
    df.filter("mask").select("scene_id", "y", "x").createOrReplaceTempView("places")
    pieces.register(spark)
    return df


def found(df):
    return sorted(tuple(r) for r in df.select("scene_id", "label", "pixels", "ymin", "ymax", "xmin", "xmax").collect())


def test_sql_equals_the_frame_form(spark, mask):
    assert found(spark.sql(BOXES.format(t=64))) == found(sizes(components(mask.dropDuplicates())))


@pytest.mark.parametrize("tile", [2, 7, 16])
def test_pieces_come_together(spark, mask, tile):
    want = found(sizes(components(mask.dropDuplicates())))
    assert found(pieces.boxes(pieces.pieces(mask, tile), tile)) == want
    if tile == 7:
        own = spark.sql("SELECT * FROM tile_components(TABLE(places) PARTITION BY (scene_id, y div 7, x div 7), 7)")
        assert found(pieces.boxes(own, 7)) == want and own.count() > len(want)


def test_nothing_set(spark, mask):
    none = mask.filter("false")
    assert pieces.pieces(none).count() == 0 and pieces.boxes(pieces.pieces(none)).count() == 0


def test_partitions_must_be_tiles(spark, mask):
    with pytest.raises(PySparkException, match="one tile a partition"):
        spark.sql("SELECT * FROM tile_components(TABLE(places) PARTITION BY (scene_id), 8)").collect()
    with pytest.raises(ValueError):
        pieces.pieces(mask, 1)


def test_files_in_sql(spark, mask):
    one, two = ((np.arange(n * 3 * c) % 251).reshape(n, 3, c).astype(np.uint16) for n, c in ((5, 2), (4, 1)))
    files = spark.createDataFrame([("f", bytearray(tiff([one, one]))), ("g", bytearray(tiff([two]))), ("none", None)], "scene_id string, content binary")
    files.createOrReplaceTempView("files")
    got = spark.sql("SELECT scene_id, y, x, samples FROM raster_pixels(TABLE(SELECT scene_id, content FROM files))")
    want = raster.pixels(files.filter("content IS NOT NULL"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 27
    frames = spark.sql("SELECT f.scene_id, r.* FROM files f, LATERAL raster_frames(f.content) r ORDER BY 1, 2").collect()
    assert [tuple(r) for r in frames] == [("f", 0, 3, 5, 2, "uint16"), ("f", 1, 3, 5, 2, "uint16"), ("g", 0, 3, 4, 1, "uint16")]
    with pytest.raises(PySparkException, match="as binary"):
        spark.sql("SELECT * FROM raster_frames('text')").collect()
    assert spark.sql("SELECT * FROM raster_frames(X'00')").count() == 0
