"""Pyramids of pictures against halving of the whole picture."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrille.operators import pyramid
from quadrille.operators.pyramid import above, as_pixels, base, levels, window, write_pyramid
from quadrille.sources.raster import png


def half_by_loops(p):
    """One place after the other."""
    h, w, _ = p.shape
    out = np.zeros(((h + 1) // 2, (w + 1) // 2, 4), np.uint8)
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            four = [[int(v) for v in p[i, j]] for i in (2 * y, 2 * y + 1) for j in (2 * x, 2 * x + 1) if i < h and j < w]
            a = sum(f[3] for f in four)
            out[y, x, 3] = int(a / len(four) + 0.5)
            if a:
                out[y, x, :3] = [int(sum(f[c] * f[3] for f in four) / a + 0.5) for c in range(3)]
    return out


def scene(name, h, w, seed, holes=0.2):
    g = np.random.default_rng(seed)
    p = g.integers(0, 256, (h, w, 4), np.uint8)
    p[g.random((h, w)) < holes] = 0
    p[h - 1, w - 1] = (9, 8, 7, 255)
    y, x = np.nonzero(p[..., 3])
    return p, pd.DataFrame({"scene_id": name, "y": y, "x": x, **{b: p[y, x, i].astype(int) for i, b in enumerate("rgba")}})


def pictures_of(rows, shape):
    out = np.zeros((*shape, 4), np.uint8)
    out[rows["y"], rows["x"]] = rows[list("rgba")]
    return out


def seen(p):
    return np.where(p[..., 3:] > 0, p, 0)


@pytest.fixture(scope="module")
def two(spark):
    (a, fa), (b, fb) = scene("a", 37, 21, 1), scene("b", 5, 3, 2)
    return {"a": a, "b": b}, spark.createDataFrame(pd.concat([fa, fb]).assign(png="clash"))


def test_levels_are_halves_of_the_whole(spark, two):
    whole, layer = two
    tiles = levels(layer, tile=8)
    got = as_pixels(tiles, 8).toPandas()
    assert sorted(got.groupby("scene_id")["level"].max().items()) == [("a", 3), ("b", 0)]
    for name, p in whole.items():
        for level in range(4 if name == "a" else 1):
            rows = got[(got["scene_id"] == name) & (got["level"] == level)]
            assert (pictures_of(rows, p.shape[:2]) == seen(p)).all()
            p = half_by_loops(p)
    shapes = tiles.groupBy("scene_id", "level").agg(F.count(F.lit(1)).alias("n"), F.max("height").alias("h")).filter("scene_id = 'a'").orderBy("level").collect()
    assert [(r["n"], r["h"]) for r in shapes] == [(15, 37), (6, 19), (2, 10), (1, 5)]


def test_no_task_has_over_four_tiles(spark, two):
    _, layer = two
    low = base(layer, tile=4)
    most = low.filter("scene_id = 'a'").groupBy("scene_id", F.floor(F.col("ty") / 2), F.floor(F.col("tx") / 2)).count().agg(F.max("count")).first()[0]
    assert most <= 4 and above(low, 4).filter("scene_id = 'b'").count() == 1
    plan = above(low, 4)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" in plan


def test_what_is_transparent_stays_so(spark):
    rows = [("s", y, x, 200, 10, 30, 255 if x < 4 else 0) for y in range(8) for x in range(8)]
    layer = spark.createDataFrame(rows, "scene_id string, y int, x int, r int, g int, b int, a int")
    got = as_pixels(levels(layer, tile=2), 2).filter("level > 0").collect()
    assert {(r["r"], r["g"], r["b"], r["a"]) for r in got if r["level"] < 3} == {(200, 10, 30, 255)}
    assert all(r["x"] < (2, 1)[r["level"] - 1] for r in got)


def test_edges(spark):
    none = spark.createDataFrame([], "scene_id string, y int, x int, r int, g int, b int, a int")
    assert levels(none).count() == 0
    rows = [("s", 0, 0, 1, 2, 3, 255), ("s", 0, 0, 4, 5, 6, 255), ("s", 9, 9, 7, 7, 7, 255)]
    layer = spark.createDataFrame(rows, none.schema)
    far = spark.createDataFrame([("s", 9, 9, 7, 7, 7, 255)], none.schema)
    assert [(r["level"], r["y"], r["x"]) for r in as_pixels(levels(far, tile=8), 8).orderBy("level").collect()] == [(0, 9, 9), (1, 4, 4)]
    size = spark.createDataFrame([("s", 3, 5)], "scene_id string, height int, width int")
    got = as_pixels(levels(layer, size, 8), 8).collect()
    assert [(r["y"], r["x"], r["r"]) for r in got] == [(0, 0, 4)]


def test_written_and_read_back(spark, two, tmp_path):
    whole, layer = two
    path = str(tmp_path / "layers")
    write_pyramid(layer, path, "ndvi", tile=8)
    first = spark.read.parquet(path).count()
    write_pyramid(layer, path, "ndvi", tile=8)
    assert spark.read.parquet(path).count() == first == 25
    top = window(spark, path, "ndvi", "a", (0, 0, 37, 21), 8).collect()
    assert [(r["level"], r["ty"], r["tx"]) for r in top] == [(3, 0, 0)]
    p = half_by_loops(half_by_loops(half_by_loops(whole["a"])))
    assert top[0]["png"] == png(seen(p)) or top[0]["png"] == png(p)
    near = window(spark, path, "ndvi", "a", (16, 8, 24, 16), 8)
    assert [(r["level"], r["ty"], r["tx"]) for r in near.collect()] == [(0, 2, 1)]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "GreaterThanOrEqual(ty" in plan and "EqualTo(scene_id,a)" in plan
    assert window(spark, path, "ndvi", "none", (0, 0, 9, 9), 8).count() == 0 and window(spark, path, "ndvi", "a", (4, 4, 4, 9), 8).count() == 0


def test_halves_by_loops():
    for h, w in ((1, 1), (2, 3), (7, 4)):
        p, _ = scene("x", h, w, h)
        assert (seen(pyramid.halved(p)) == seen(half_by_loops(p))).all()
