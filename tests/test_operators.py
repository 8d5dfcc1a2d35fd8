"""Operators against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.functions import pixels as px
from quadrille.operators import bands, change, features, indices, masks, neighbours, radar
from quadrille.operators.components import components, label_tile, numbered, sizes
from quadrille.operators.resample import resample
from quadrille.operators.scenes import extents, quantiles
from quadrille.sources import grids


def pixels(spark, scenes: dict[str, dict[str, np.ndarray]]):
    parts = []
    for name, arrays in scenes.items():
        h, w = next(iter(arrays.values())).shape
        y, x = np.mgrid[:h, :w]
        parts.append(pd.DataFrame({"scene_id": name, "y": y.ravel(), "x": x.ravel(), **{k: a.ravel() for k, a in arrays.items()}}))
    return spark.createDataFrame(pd.concat(parts))


def grid(df, column: str, shape: tuple[int, int], scene: str = "s", fill=0) -> np.ndarray:
    rows = df.filter(F.col("scene_id") == scene).select("y", "x", column).toPandas()
    out = np.full(shape, fill, dtype=rows[column].dtype if len(rows) else float)
    out[rows["y"], rows["x"]] = rows[column]
    return out


def flood(m: np.ndarray) -> np.ndarray:
    """Labels from 1 in the order of rows, by a plain walk."""
    out, n = np.zeros(m.shape, int), 0
    for start in zip(*np.nonzero(m), strict=True):
        if out[start]:
            continue
        n, todo = n + 1, [start]
        out[start] = n
        while todo:
            y, x = todo.pop()
            for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b] and not out[a, b]:
                    out[a, b] = n
                    todo.append((a, b))
    return out


def erode(m):
    p = np.pad(m, 1)
    return p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]


def dilate(m):
    p = np.pad(m, 1)
    return p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]


def clean(m):
    return erode(erode(dilate(dilate(dilate(erode(m))))))


def spiral(n: int = 21) -> np.ndarray:
    m = np.zeros((n, n), bool)
    y, x, dy, dx = 0, 0, 0, 1
    m[0, 0] = True
    for _ in range(n * n):
        a, b = y + 2 * dy, x + 2 * dx
        if not (0 <= y + dy < n and 0 <= x + dx < n) or (0 <= a < n and 0 <= b < n and m[a, b]):
            dy, dx = dx, -dy
            if m[(y + dy) % n, (x + dx) % n]:
                break
        y, x = y + dy, x + dx
        if not (0 <= y < n and 0 <= x < n):
            break
        m[y, x] = True
    return m


MASKS = {"full": np.ones((13, 17), bool), "empty": np.zeros((5, 4), bool), "dot": np.eye(1, dtype=bool), "diagonal": np.eye(9, dtype=bool), "spiral": spiral(), "noise": np.random.default_rng(4).random((40, 33)) < 0.6}


def test_constant_scene_is_dense(spark):
    df = pixels(spark, {"s": {"red": np.full((100, 100), 51.0), "green": np.full((100, 100), 102.0), "blue": np.full((100, 100), 25.5), "nir": np.full((100, 100), 204.0)}})
    stats, limit = indices.vegetation_stats(bands.normalise(df))
    row = stats.first()
    # Bands are scaled by their own maximum, here all 255.
    assert limit is None and row["mean_ndvi"] == pytest.approx(0.6, abs=0.005) and row["dense_vegetation_pct"] == 100.0


def test_visible_substitute_comes_with_a_limitation(spark):
    df = pixels(spark, {"s": {b: np.full((5, 5), v) for b, v in (("red", 40), ("green", 90), ("blue", 30))}})
    stats, limit = indices.vegetation_stats(bands.normalise(df))
    assert limit and stats.first()["estimated_vegetation_pct"] == 100.0


def test_missing_samples_are_in_no_mask_and_count_only_for_water(spark):
    red = np.array([[0.1, 0.1], [0.5, 0.1]])
    df = pixels(spark, {"s": {"red": red, "green": red + 0.2, "blue": red, "nir": red + 0.3}})
    df = df.withColumn("nir", F.when((F.col("y") == 0) & (F.col("x") == 0), F.lit(float("nan"))).otherwise(F.col("nir"))).withColumn("nir", px.without("nir", None))
    stats = indices.ndvi_stats(bands.normalise(df)).first()
    assert stats["dense_vegetation_pct"] + stats["moderate_vegetation_pct"] + stats["sparse_vegetation_pct"] + stats["non_vegetated_pct"] == pytest.approx(100, abs=0.02)
    assert indices.ndwi_stats(bands.normalise(df)).first()["water_coverage_pct"] == 0
    assert not grid(masks.mask(df, "vegetation"), "mask", (2, 2))[0, 0]


def test_scenes_do_not_mix(spark):
    a, b = np.full((4, 4), 200), np.full((4, 4), 1)
    out = bands.normalise(pixels(spark, {"a": {"red": a}, "b": {"red": b}}))
    assert grid(out, "red", (4, 4), "a")[0, 0] == pytest.approx(200 / 255) and grid(out, "red", (4, 4), "b")[0, 0] == 1


@pytest.mark.parametrize("kind", ["float", "ties", "one"])
def test_quantiles(spark, kind):
    rng = np.random.default_rng(1)
    v = {"float": rng.normal(size=(30, 40)), "ties": rng.integers(0, 3, (30, 40)) / 2.0, "one": np.full((1, 1), 3.5)}[kind]
    got = quantiles(pixels(spark, {"s": {"v": v}}), {"v": "v"}, [0.02, 0.5, 0.75, 1.0]).first()
    assert [got[f"v_q{i}"] for i in range(4)] == pytest.approx(np.quantile(v, [0.02, 0.5, 0.75, 1.0]), abs=1e-12)


@pytest.mark.parametrize("tile", [4, 256])
def test_morphology_and_components(spark, tile):
    df = pixels(spark, {k: {"mask": m} for k, m in MASKS.items()})
    got = neighbours.cleaned(df, tile=tile)
    edges = neighbours.boundary(df, tile)
    labels = components(df, tile=tile)
    ranks = numbered(sizes(labels))
    named = labels.join(ranks.select("scene_id", "label", "number"), ["scene_id", "label"])
    for k, m in MASKS.items():
        assert (grid(got, "mask", m.shape, k, False).astype(bool) == clean(m)).all(), k
        assert (grid(edges, "edge", m.shape, k, False).astype(bool) == (m & ~erode(m))).all(), k
        assert (grid(named, "number", m.shape, k).astype(int) == flood(m)).all(), k


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 24), st.integers(1, 24), st.floats(0.1, 0.9))
def test_labels_of_a_tile(seed, h, w, share):
    m = np.random.default_rng(seed).random((h, w)) < share
    got, want = label_tile(m), flood(m)
    assert (got >= 0).tolist() == m.tolist()
    for n in range(1, want.max() + 1):
        own = got[want == n]
        assert (own == np.flatnonzero(want == n)[0]).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_opening_is_inside(seed):
    m = np.random.default_rng(seed).random((15, 15)) < 0.7
    there = np.ones_like(m)
    opened = neighbours.dilated(neighbours.eroded(m), there)
    assert not (opened & ~m).any()


@pytest.mark.parametrize("tile", [8, 256])
@pytest.mark.parametrize("shape", [(13, 17), (1, 5), (3, 3)])
def test_box_mean_and_lee(spark, tile, shape):
    v = np.random.default_rng(2).normal(size=shape)
    df = pixels(spark, {"s": {"v": v}})
    p = np.pad(v, 2, mode="symmetric")
    win = np.lib.stride_tricks.sliding_window_view(p, (5, 5))
    mean, var = win.mean(axis=(2, 3)), np.maximum((win**2).mean(axis=(2, 3)) - win.mean(axis=(2, 3)) ** 2, 0)
    assert grid(neighbours.box_mean(df, "v", tile=tile), "mean", shape) == pytest.approx(mean, abs=1e-12)
    weight = var / (var + np.percentile(var, 20) + 1e-6)
    assert grid(neighbours.lee(df, "v", tile=tile), "filtered", shape) == pytest.approx(mean + weight * (v - mean), abs=1e-9)


def test_otsu(spark):
    v = np.abs(np.concatenate([np.random.default_rng(3).normal(0.1, 0.02, 800), np.random.default_rng(5).normal(0.7, 0.05, 200)])).reshape(25, 40)
    got = change.otsu(pixels(spark, {"s": {"magnitude": v}})).first()
    counts, edges = np.histogram(v, bins=256, range=(0.0, v.max() + 1e-4))
    p, c = counts / v.size, (edges[:-1] + edges[1:]) / 2
    om, mu = np.cumsum(p), np.cumsum(p * c)
    between = (mu[-1] * om - mu) ** 2 / (om * (1 - om) + 1e-8)
    assert got["otsu"] == pytest.approx(c[between.argmax()], abs=1e-9)
    assert 0 <= got["eta"] <= 1 and got["eta"] == pytest.approx(min(between.max() / (v.var() + 1e-8), 1), abs=1e-9)
    assert got["threshold"] == pytest.approx(max(c[between.argmax()], v.mean() + 1.2 * v.std(), 0.22), abs=1e-9)


def weights(n: int, to: int) -> np.ndarray:
    out, scale = np.zeros((to, n)), n / to
    wide = max(scale, 1.0)
    for t in range(to):
        c = (t + 0.5) * scale
        for s in range(max(0, int(c - wide + 0.5)), min(n, int(c + wide + 0.5))):
            out[t, s] = max(0.0, 1 - abs(s + 0.5 - c) / wide)
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("to", [(5, 7), (20, 31), (10, 12)])
def test_resample(spark, to):
    v = np.random.default_rng(6).random((10, 12))
    target = spark.createDataFrame([("s", *to)], "scene_id string, height long, width long")
    got = grid(resample(pixels(spark, {"s": {"v": v}}), target, ["v"]), "v", to)
    assert got == pytest.approx(weights(10, to[0]) @ v @ weights(12, to[1]).T, abs=1e-9)


def test_change_on_the_pair(spark):
    a, b = (grids.synthetic(spark, n, 96, 96) for n in ("before", "after"))
    got = change.detect(a, b, "areas where vegetation decreased and buildings increased")
    m = got["metrics"].first()
    assert m["total_change_pct"] > 2 and 0 <= m["otsu_separability_eta"] <= 1 and got["limitation"]
    found = got["features"].collect()
    assert found and any("Converted to Built-up" in f["label"] for f in found)
    assert features.spatial_intersection(got["features"]).count() == m["compound_transitions_count"]


def test_fusion_on_the_harbour(spark):
    o = grids.synthetic(spark, "coast", 96, 96).withColumn("scene_id", F.lit("radar"))
    got = radar.fuse(o, grids.synthetic(spark, "radar", 96, 96))
    m = got["metrics"].first()
    assert m["fused_structures_count"] >= 1 and m["mean_backscatter_db"] is not None
    assert len(got["insights"].first()["insights"]) == 3


def test_grounding_on_the_coast(spark):
    from quadrille.plans.registry import ground

    df = grids.synthetic(spark, "coast", 128, 128)
    got = ground(df, "water")
    mask = grid(got["mask"], "mask", (128, 128), "coast", False).astype(bool)
    raw = grid(masks.mask(df, "water"), "mask", (128, 128), "coast", False).astype(bool)
    assert (mask == clean(raw)).all()
    labels, sizes_of = flood(mask), {}
    for n in range(1, labels.max() + 1):
        sizes_of[n] = int((labels == n).sum())
    best = sorted(sizes_of, key=lambda n: (-sizes_of[n], n))[:10]
    best = [n for n in best if sizes_of[n] >= max(int(128 * 128 * 0.001), 25)]
    found = got["features"].orderBy("rank").collect()
    assert len(found) == len(best)
    for f, n in zip(found, best, strict=True):
        ys, xs = np.nonzero(labels == n)
        assert (f["pixel_bounds"]["ymin_px"], f["pixel_bounds"]["xmax_px"]) == (ys.min(), xs.max() + 1)
        box = mask[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
        assert f["confidence"] == pytest.approx(min(0.7 + 0.28 * box.mean(), 0.98), abs=0.006)
        edge = np.nonzero((labels == n) & ~erode(labels == n))
        stride = max(1, len(edge[0]) // 24)
        assert len(f["polygon"]) == -(-len(edge[0]) // stride)
        assert all(0 <= p["x"] <= 1 and 0 <= p["y"] <= 1 for p in f["polygon"])
    stats = got["stats"].first()
    assert stats["total_pixels"] == mask.sum() and stats["detected_clusters"] == len(best) and stats["coverage_percentage"] > 50


def test_dispatch_rules(spark):
    names = ["water", "Vegetation_loss", "built_up", "builtup_gain", "urban", "", "airport"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    for strict in (True, False):
        got = [r["k"] for r in df.select(px.feature_kind(F.col("f"), strict).alias("k")).collect()]
        assert got == [masks.kind_of(n, strict) for n in names]
    assert masks.kind_of("built_up") == "salient" and masks.kind_of("built_up", strict=False) == "built_up"


def test_empty_tables(spark):
    df = pixels(spark, {"s": {b: np.ones((2, 2)) for b in ("red", "green", "blue", "nir")}}).limit(0)
    assert indices.ndvi_stats(bands.normalise(df)).count() == 0
    assert neighbours.cleaned(df.select("scene_id", "y", "x", F.lit(True).alias("mask"))).count() == 0
    assert components(df.select("scene_id", "y", "x", F.lit(True).alias("mask"))).count() == 0
    assert extents(df).count() == 0


def test_confidences_round_halves_up(spark):
    """A fill of seven eighths is a confidence of 0.945, and 0.92 and 0.93 have the mean 0.925."""
    fills = spark.createDataFrame([(0.875,), (0.75,), (1.0,)], "fill double")
    assert [r[0] for r in fills.select(px.grounding_confidence(F.col("fill"))).collect()] == [0.95, 0.91, 0.98]
    found = spark.createDataFrame([("a", 0.92), ("a", 0.93), ("c", 0.7)], "scene_id string, confidence double")
    scenes = spark.createDataFrame([("a",), ("b",), ("c",)], "scene_id string")
    assert dict(features.response_confidence(found, scenes).collect()) == {"a": 0.93, "b": None, "c": 0.7}
    assert dict(features.response_confidence(found).collect()) == {"a": 0.93, "c": 0.7}
