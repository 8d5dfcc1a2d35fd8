"""What keeps large scenes in bounds: quantiles by ranks, value histograms, tables by tile, summed areas."""

import math
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrille.operators import change, features, neighbours, overlay, scenes
from quadrille.operators.storage import save_by_tile, tiled_session, written
from quadrille.operators.sums import box_sums, tile_sums
from quadrille.sources import grids

SHARES = [0.0, 0.02, 0.5, 0.75, 0.98, 1.0]
RNG = np.random.default_rng(4)
TAILS = {
    "outlier": np.append(RNG.random(30_000), 1e300),
    "outliers on both sides": np.concatenate([RNG.normal(size=9_000), [-1e18, 1e18, 3e18]]),
    "log-uniform": 10.0 ** RNG.uniform(-200, 200, 20_000) * RNG.choice([-1, 1], 20_000),
    "ties and a tail": np.concatenate([np.full(20_000, 0.25), 1 / RNG.random(5_000)]),
    "two values": np.repeat([-0.5, 1e9], [7, 3]),
    "one": np.array([2.5]),
    "with NaN": np.append(RNG.random(500), [np.nan] * 70),
}


@pytest.fixture(scope="module")
def tails(spark):
    rows = pd.concat([pd.DataFrame({"scene_id": k, "v": v}) for k, v in TAILS.items()])
    return written(spark.createDataFrame(rows).repartition(4), "tails")


@pytest.mark.parametrize("most", [500_000, 40])
@pytest.mark.parametrize("few", [True, False])
def test_quantiles_of_heavy_tails(tails, most, few, monkeypatch):
    """However the values lie, a task orders at most ``most`` of them."""
    ordered = []
    real = scenes.picked

    def watched(held, on, limit):
        out = real(held, on, limit)
        return out

    def narrowed(held, on, real=scenes._narrowed):
        made = real(held, on)
        ordered.append(held.count())
        return made

    monkeypatch.setattr(scenes, "picked", watched)
    monkeypatch.setattr(scenes, "_narrowed", narrowed)
    got = {r["scene_id"]: r for r in scenes.quantiles(tails, {"v": "v"}, SHARES, few, [F.count("v").alias("n")], most).collect()}
    for name, v in TAILS.items():
        v = v[~np.isnan(v)]
        want = np.quantile(v, SHARES)
        assert [got[name][f"v_q{i}"] for i in range(len(SHARES))] == pytest.approx(want, rel=1e-9, abs=1e-12), name
    assert ordered == sorted(ordered, reverse=True)


def test_one_outlier_leaves_little_to_order(spark, monkeypatch):
    n = 2_000_000
    values = spark.range(n).select(F.lit("s").alias("scene_id"), F.when(F.col("id") == 77, 1e15).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)).alias("v"))
    kept = []

    def counting(df, name, real=scenes.written):
        made = real(df, name)
        if name in ("between", "held"):
            kept.append(made.count())
        return made

    monkeypatch.setattr(scenes, "written", counting)
    got = scenes.quantiles(values, {"v": "v"}, [0.02, 0.5, 0.98], True).first()
    assert max(kept) <= 3 * n * 4 * scenes.SLACK + 10, "some ten-thousandths of the values are ordered, not a bin that holds them all"
    v = np.sort(values.toPandas()["v"])
    assert [got[f"v_q{i}"] for i in range(3)] == pytest.approx(np.quantile(v, [0.02, 0.5, 0.98]), rel=1e-12)


def test_narrowing_keeps_both_values_beside_a_rank(spark):
    """The wanted rank lies between the last value of a part and the first of the next."""
    rows = [("s", 31.5, 0, float(v), 1) for v in range(64)]
    held = written(spark.createDataFrame(rows, "scene_id string, at double, below long, v double, n long"), "rows")
    assert scenes.picked(held, ["scene_id"], 3).first()["q"] == 31.5


def test_value_histogram(spark):
    a = RNG.integers(0, 9, (30, 20))
    df = spark.createDataFrame(pd.DataFrame({"scene_id": "s", "y": np.repeat(range(30), 20), "x": list(range(20)) * 30, "red": a.ravel(), "nir": a.ravel() * 100})).withColumns({"red": F.col("red").cast("short"), "nir": F.col("nir").cast("int")})
    found, counts = scenes.band_statistics(df, ["red", "nir"], [0.02, 0.98], True)
    row = found.first()
    assert (row["low_red"], row["high_nir"]) == (a.min(), a.max() * 100) and row["red_q1"] == pytest.approx(np.quantile(a, 0.98)) and counts.agg(F.sum("n")).first()[0] == 1200
    assert scenes.band_statistics(df.select("*", F.col("red").cast("double").alias("soft")), ["soft"], [0.5])[1] is None


def pair(spark, h=40, w=30):
    out = []
    for k in (0, 1):
        y, x = np.mgrid[:h, :w]
        rows = pd.DataFrame({"scene_id": "s", "y": y.ravel(), "x": x.ravel()})
        for i, b in enumerate(("red", "green", "blue", "nir")):
            rows[b] = np.random.default_rng(10 * k + i).integers(0, 250, h * w)
        out.append(written(spark.createDataFrame(rows).withColumns({b: F.col(b).cast("int") for b in ("red", "green", "blue", "nir")}), f"date{k}"))
    return out


def scans_of(df, column: str) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return sum("FileScan" in line and bool(re.search(rf"[\[,]{column}#", line)) for line in plan)


def test_change_reads_each_date_once_for_counts_and_once_for_pixels(spark, monkeypatch):
    a, b = pair(spark)
    plans = []

    def watched(df, name, real=scenes.written):
        plans.append((name, scans_of(df, "red")))
        return real(df, name)

    monkeypatch.setattr(scenes, "written", watched)
    monkeypatch.setattr(change, "written", watched)
    made = change.deltas(a, b, True)
    assert sum(n for _, n in plans) == 2, plans
    assert scans_of(made, "red") == 2


def test_moments_follow_from_counts(spark):
    a, _ = pair(spark)
    view, known = change.dated(a, True)
    want, got = change.moments(view).first(), known.first()
    assert all(got[c] == pytest.approx(want[c], abs=1e-12) for c in known.columns[1:])
    soft = a.withColumns({b: F.col(b).cast("double") for b in ("red", "green", "blue", "nir")})
    assert change.dated(soft, True).moments is None
    both = [{(r["y"], r["x"]): r["magnitude"] for r in change.deltas(d, d2, True).collect()} for d, d2 in ((a, pair(spark)[1]), (soft, pair(spark)[1]))]
    assert both[0].keys() == both[1].keys() and all(both[0][k] == pytest.approx(both[1][k], abs=1e-9) for k in both[0])


def test_dates_kept_by_tile_meet_without_a_shuffle(spark):
    own = tiled_session(spark)
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.conf.set("spark.sql.maxMetadataStringLength", "5000")
    a, b = pair(own)
    kept = [save_by_tile(d, f"kept_{k}", 4, 16) for k, d in enumerate((a, b))]
    made = change.deltas(*kept, True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    of_pixels = r"Exchange hashpartitioning\([^)]*\by#"
    assert "SortMergeJoin" in plan and not re.search(of_pixels, plan)
    plain = change.deltas(a, b, True)
    assert re.search(of_pixels, plain._jdf.queryExecution().executedPlan().toString())
    got, want = ({(r["y"], r["x"]): r["magnitude"] for r in d.collect()} for d in (made, plain))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    one = kept[0].filter("scene_id = 's' and tile_y = 1 and tile_x = 0")
    assert "EqualTo(tile_y,1)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 256


@pytest.mark.parametrize("few", [True, False])
def test_box_sums(spark, few):
    """Boxes of any size and place against numpy; the second scene has holes and a tile without pixels."""
    a = RNG.integers(0, 100, (50, 41)).astype(float)
    b = a.copy()
    b[8:16, 8:24] = 0
    rows = []
    for name, arr in (("a", a), ("b", b)):
        y, x = np.nonzero(arr)
        rows.append(pd.DataFrame({"scene_id": name, "y": y, "x": x, "v": arr[y, x]}))
    tiles = written(tile_sums(spark.createDataFrame(pd.concat(rows)), "v", 8), "tiles")
    boxes = []
    for i in range(60):
        (y0, y1), (x0, x1) = sorted(RNG.choice(51, 2, replace=False)), sorted(RNG.choice(42, 2, replace=False))
        boxes.append(("ab"[i % 2], i, int(y0), int(y1), int(x0), int(x1)))
    df = written(spark.createDataFrame(boxes, "scene_id string, box long, ymin long, ymax long, xmin long, xmax long"), "boxes")
    got = {r["box"]: r["total"] for r in box_sums(df, tiles, few, 8).collect()}
    for name, i, y0, y1, x0, x1 in boxes:
        assert got[i] == pytest.approx((a if name == "a" else b)[y0:y1, x0:x1].sum())


def test_fill_density_reads_tiles(spark):
    mask = RNG.random((60, 60)) < 0.6
    y, x = np.nonzero(mask)
    labels = spark.createDataFrame(pd.DataFrame({"scene_id": "s", "y": y, "x": x, "label": 1}))
    top = spark.createDataFrame([("s", 1, 3, 40, 5, 58)], "scene_id string, label long, ymin long, ymax long, xmin long, xmax long")
    made = features.fill_density(top, labels, True)
    assert made.first()["fill"] == pytest.approx(mask[3:40, 5:58].mean())
    assert not [line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "NestedLoop" in line or "Cartesian" in line]


def test_wide_windows_cost_little_more(spark):
    a = RNG.normal(size=(700, 500)) * 3 - 20
    y, x = np.mgrid[:700, :500]
    df = written(spark.createDataFrame(pd.DataFrame({"scene_id": "s", "y": y.ravel(), "x": x.ravel(), "v": a.ravel()})), "window")
    took = {}
    for k in (5, 5, 51):
        began = time.perf_counter()
        made = neighbours.box_mean(df, "v", k, True).toPandas()
        took[k] = time.perf_counter() - began
        got = np.zeros_like(a)
        got[made["y"], made["x"]] = made["mean"]
        r = k // 2
        padded = np.pad(a, r, mode="symmetric")
        s = np.zeros((padded.shape[0] + 1, padded.shape[1] + 1))
        s[1:, 1:] = padded.cumsum(0).cumsum(1)
        assert np.allclose(got, (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / k**2, atol=1e-9)
        square = np.zeros_like(a)
        square[made["y"], made["x"]] = made["square"]
        assert (square - got**2 >= -1e-9).all()
    assert took[51] < 2.5 * took[5]


# --- shapes ------------------------------------------------------------------------------------------------------


#: Corners lie on whole numbers of this part of a scene, so that plain arithmetic is exact.
GRAIN = 4096


def crossing(p: list, q: list) -> bool:
    """Whether two polygons of whole-number corners share a point, edge by edge, or a corner of one is inside the other."""
    if any(max(t[k] for t in p) < min(t[k] for t in q) or max(t[k] for t in q) < min(t[k] for t in p) for k in (0, 1)):
        return False
    side = lambda o, s, t: (s[0] - o[0]) * (t[1] - o[1]) - (s[1] - o[1]) * (t[0] - o[0])
    on = lambda o, s, t: side(o, s, t) == 0 and min(o[0], s[0]) <= t[0] <= max(o[0], s[0]) and min(o[1], s[1]) <= t[1] <= max(o[1], s[1])

    def inside(poly, t):
        hit = False
        for i, o in enumerate(poly):
            s = poly[i - 1]
            if on(o, s, t):
                return True
            if (o[1] > t[1]) != (s[1] > t[1]) and t[0] < (s[0] - o[0]) * (t[1] - o[1]) / (s[1] - o[1]) + o[0]:
                hit = not hit
        return hit

    for i, a in enumerate(p):
        b = p[i - 1]
        for j, c in enumerate(q):
            d = q[j - 1]
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0 or on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b):
                return True
    return inside(q, p[0]) or inside(p, q[0])


def stars(r: random.Random, n: int, scenes: int, most: float = 0.04) -> list[tuple]:
    out = []
    for i in range(n):
        cy, cx, size, k = r.random(), r.random(), most * r.random() ** 2, r.randint(3, 9)
        turn = sorted(r.random() * 2 * math.pi for _ in range(k))
        at = [(round((cx + size * r.uniform(0.3, 1) * math.cos(t)) * GRAIN), round((cy + size * r.uniform(0.3, 1) * math.sin(t)) * GRAIN)) for t in turn]
        out.append((f"s{i % scenes}", f"f{i}", at))
    return out


def shapes_of(spark, stars: list[tuple]):
    rows = [(s, i, *(f(t[k] for t in p) / GRAIN for f in (min, max) for k in (1, 0)), [(x / GRAIN, y / GRAIN) for x, y in p]) for s, i, p in stars]
    return spark.createDataFrame(rows, "scene_id string, id string, ymin double, xmin double, ymax double, xmax double, polygon array<struct<x:double,y:double>>")


@pytest.mark.parametrize("cells", [7, 64])
def test_overlapping_polygons(spark, cells):
    r = random.Random(cells)
    a, b = stars(r, 1000, 3), [*stars(r, 990, 3), *stars(r, 10, 3, 1.5)]
    df = overlay.overlapping(shapes_of(spark, a), shapes_of(spark, b), cells)
    got = [(x["a"]["id"], x["b"]["id"]) for x in df.collect()]
    want = {(i, j) for s, i, p in a for t, j, q in b if s == t and crossing(p, q)}
    assert set(got) == want and len(got) == len(want)
    boxes = overlay.meeting_boxes(shapes_of(spark, a), shapes_of(spark, b), cells).count()
    assert boxes > len(want), "polygons decide more than boxes do"
    met = features.spatial_intersection(shapes_of(spark, a), shapes_of(spark, b))
    assert {x["id"] for x in met.collect()} == {i for i, _ in want}


def test_a_scene_of_many_features_is_spread(spark):
    rows = spark.range(100_000).select(F.lit("s").alias("scene_id"), F.col("id").cast("string").alias("id"), (F.floor(F.col("id") / 320) / 320).alias("ymin"), (F.col("id") % 320 / 320).alias("xmin"))
    rows = rows.select("*", (F.col("ymin") + 0.001).alias("ymax"), (F.col("xmin") + 0.001).alias("xmax"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = overlay.meeting_boxes(rows, rows.hint("shuffle_hash"))
        per_task = [len(p) for p in pairs.select("a.id").rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(per_task) == 100_000 and max(per_task) < 0.5 * sum(per_task)


def test_shapes_without_a_place_or_a_polygon(spark):
    kind = "scene_id string, id string, ymin double, xmin double, ymax double, xmax double, polygon array<struct<x:double,y:double>>"
    a = spark.createDataFrame([("s", "box", 0.1, 0.1, 0.2, 0.2, None), ("s", "none", None, None, None, None, None), ("t", "other", 0.1, 0.1, 0.2, 0.2, []), ("s", "turned", 0.3, 0.3, 0.1, 0.4, None)], kind)
    b = spark.createDataFrame([("s", "corner", 0.2, 0.2, 0.3, 0.3, [(0.2, 0.2)]), ("s", "out", -3.0, -3.0, -2.0, -2.0, None)], kind)
    assert [(x["a"]["id"], x["b"]["id"]) for x in overlay.overlapping(a, b).collect()] == [("box", "corner")]
    assert overlay.overlapping(a.limit(0), b).collect() == []


def test_boxes_alone_are_decided_by_the_join(spark):
    """Tables without polygons need no Python, tables with some get the same pairs of the shapes that have none."""
    r = random.Random(5)
    sides = [[(f"s{i % 2}", f"{i}", y, x, y + r.randint(0, 9) / 100, x + r.randint(0, 9) / 100) for i in range(300) for y, x in [(r.randint(0, 95) / 100, r.randint(0, 95) / 100)]] for _ in "ab"]
    want = sorted((p[1], q[1]) for p in sides[0] for q in sides[1] if p[0] == q[0] and all(p[k] <= q[k + 2] and q[k] <= p[k + 2] for k in (2, 3)))
    a, b = (spark.createDataFrame(rows, "scene_id string, id string, ymin double, xmin double, ymax double, xmax double") for rows in sides)
    bare = overlay.overlapping(a, b)
    assert "InPandas" not in bare._jdf.queryExecution().executedPlan().toString()
    with_none = b.withColumn("polygon", F.lit(None).cast("array<struct<x:double,y:double>>"))
    for made in (bare, overlay.overlapping(a, with_none)):
        assert sorted((x["a"]["id"], x["b"]["id"]) for x in made.collect()) == want


def test_grids_are_whole_numbers(spark):
    """The queries' bands go through the histogram."""
    g = grids.optical(grids.grid_t1(spark, "/root/testdata/sf0.001"))
    assert all(scenes.is_whole(g, b) for b in grids.SAMPLES)
