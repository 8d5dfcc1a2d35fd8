import functools
import json

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadrille.functions.intent import parse_one, parsed
from quadrille.operators import change, radar
from quadrille.plans import engine, providers
from quadrille.plans.registry import health, standard
from quadrille.schema import METADATA, RESULT
from quadrille.sources import grids

COMPOUND = "Find areas where vegetation decreased while built-up land increased between two dates"


def test_compound_plan(spark):
    p = parse_one(spark, COMPOUND)
    assert p["primary_intent"] == "COMPOUND_CHANGE" and len(p["steps"]) == 8
    assert {"step_temporal_align", "step_cva", "step_spatial_intersection"} <= set(p["steps"])
    assert p["target_features"][:2] == ["vegetation_loss", "builtup_gain"]


@pytest.mark.parametrize(
    ("text", "intent", "targets"),
    [
        ("where are the water bodies", "SPATIAL_GROUNDING", ["water"]),
        ("what changed", "CHANGE_DETECTION", []),
        ("compare optical and radar", "OPTICAL_SAR", []),
        ("hello", "SCENE_DESCRIPTION", []),
        ("the airport", "SPATIAL_GROUNDING", ["built_up"]),
        ("a street", "SPECTRAL_VEGETATION", ["vegetation"]),
        ("types of land", "LAND_COVER", []),
    ],
)
def test_intents(spark, text, intent, targets):
    p = parse_one(spark, text)
    assert (p["primary_intent"], p["target_features"]) == (intent, targets)


def test_null_question_and_hint(spark):
    df = parsed(spark.createDataFrame([(None,)], "query string")).first()
    assert df["primary_intent"] == "SCENE_DESCRIPTION" and not df["requires_sar"]
    p = parse_one(spark, "where is the lake", hint="CHANGE_DETECTION")
    assert p["primary_intent"] == "CHANGE_DETECTION" and "step_cva" in p["steps"] and p["requires_grounding"]


def test_registry(spark):
    r = standard()
    assert len(r.tools) == 14 and r.listed(spark).count() == 14
    with pytest.raises(KeyError):
        r.execute("none")
    told = spark.createDataFrame([("SPECTRAL_WATER", "{}", [], None)], "task_type string, metrics string, features array<struct<label string>>, limitations string")
    shape = StructType([f for f in RESULT if f.name == "features"])
    told = told.drop("features").crossJoin(spark.createDataFrame([([],)], shape)).crossJoin(spark.createDataFrame([(None,)], StructType().add("metadata", METADATA)))
    assert "Nothing of that kind" in r.execute("vqa_reasoner", rows=told).first()["answer"]
    coast = grids.synthetic(spark, "coast", 40, 40)
    stats, _ = r.execute("water_detector", pixels=coast)
    assert stats.first()["water_coverage_pct"] > 30
    assert r.execute("optical_analyzer", pixels=coast).first()["channels"] == 4


def test_providers(spark):
    assert providers.provider("gemini") == "local" and providers.provider("x", ("openai", "groq")) == "groq"
    clients = {"gemini": lambda c: c["query"], "openai": lambda c: c["query"], "own": lambda c: c["query"]}
    assert providers.active(spark) == "local" and providers.active(spark, clients) == "gemini"
    spark.conf.set(providers.SETTING, " OWN ")
    try:
        assert providers.active(spark, clients) == "own" and providers.active(spark) == "local"
        got = {r["name"]: r for r in providers.listed(spark, clients).collect()}
        assert len(got) == 6 and [n for n, r in got.items() if r["is_active"]] == ["own"] and not got["groq"]["available"] and got["local"]["available"]
        assert got["local"]["mode"] == "LOCAL ANALYSIS" and got["own"]["mode"].startswith("REMOTE")
        assert health(spark, clients).first()["provider"] == "own" and health(spark).first()["tool_count"] == 14
    finally:
        spark.conf.unset(providers.SETTING)


def test_a_service_answers_and_what_it_leaves_is_worded_locally(spark):
    """Answers of a client count; rows it leaves are worded locally, with a note among the limitations."""
    two = [grids.synthetic(spark, "coast", 40, 40).withColumn("scene_id", F.lit(s)) for s in ("a", "b")]
    pixels, calls = two[0].union(two[1]), {"groq": lambda c: F.when(F.col("scene_id") == "a", F.concat(F.lit("told: "), c["query"]))}
    got = {r["scene_id"]: r for r in engine.analyze(spark, pixels, "Where is the water?", clients=calls).collect()}
    plain = {r["scene_id"]: r for r in engine.analyze(spark, pixels, "Where is the water?").collect()}
    assert got["a"]["answer"] == "told: Where is the water?" and got["a"]["provider"] == "groq" and got["a"]["limitations"] == plain["a"]["limitations"]
    assert got["b"]["provider"] == plain["b"]["provider"] == "local" and got["b"]["limitations"].endswith("[groq gave no answer; worded locally]")
    assert got["b"]["answer"].split("\nLimitation")[0] == plain["b"]["answer"].split("\nLimitation")[0] and "groq" in got["b"]["answer"]


def test_analysis_of_several_scenes(spark):
    coast = grids.synthetic(spark, "coast", 64, 64)
    both = coast.union(coast.withColumn("scene_id", F.lit("coast2")))
    rows = engine.analyze(spark, both, "Where is the water and the vegetation?").collect()
    assert len(rows) == 2
    for r in rows:
        assert r["task_type"] == "SPATIAL_GROUNDING" and r["features"] and r["confidence"] is not None
        assert "clusters of" in r["answer"] and "mean_ndvi" in r["metrics"] and "water_coverage_pct" in r["metrics"]
        assert {t["status"] for t in r["trace"]} == {"completed"}


def test_values_of_change_metrics(spark):
    a, b = (grids.synthetic(spark, n, 96, 96) for n in ("before", "after"))
    got = change.detect(a, b, COMPOUND)
    p, m, n = got["pixels"].toPandas(), got["metrics"].first(), 96 * 96
    assert len(p) == n and p["mask"].any()
    for column, name in (("mask", "total_change_pct"), ("loss", "vegetation_loss_pct"), ("built", "builtup_expansion_pct"), ("water", "water_fluctuation_pct")):
        assert m[name] == pytest.approx(100 * p[column].sum() / n, abs=0.0051)
    assert m["mean_cva_magnitude"] == pytest.approx(p["magnitude"].mean(), abs=1e-4) and m["total_changed_hectares"] == pytest.approx(p["mask"].sum() * 100 / 10_000, abs=0.0051)
    v = p["magnitude"].to_numpy()
    counts, edges = np.histogram(v, 256, (0, v.max() + 1e-4))
    centre, share = (edges[1:] + edges[:-1]) / 2, counts / n
    omega, mu = share.cumsum(), (share * centre).cumsum()
    between = (mu[-1] * omega - mu) ** 2 / (omega * (1 - omega) + 1e-8)
    assert m["threshold_used"] == pytest.approx(max(centre[between.argmax()], v.mean() + 1.2 * v.std(), 0.22), abs=1e-3)
    assert m["otsu_separability_eta"] == pytest.approx(min(between.max() / (v.var() + 1e-8), 1), abs=1e-3)
    assert m["clusters_count"] == got["features"].count() <= 8


def test_values_of_fusion_metrics(spark):
    o = grids.synthetic(spark, "coast", 64, 64).withColumn("scene_id", F.lit("radar"))
    got = radar.fuse(o, grids.synthetic(spark, "radar", 64, 64))
    db, m = got["radar"].toPandas()["filtered"], got["metrics"].first()
    assert m["mean_backscatter_db"] == pytest.approx(db.mean(), abs=0.0051) and m["max_backscatter_db"] == pytest.approx(db.max(), abs=0.0051) and m["std_backscatter_db"] == pytest.approx(db.std(ddof=0), abs=0.0051)
    assert m["metallic_builtup_scatter_pct"] == pytest.approx(100 * (db > -6).mean(), abs=0.0051) and m["vegetative_volume_scatter_pct"] == pytest.approx(100 * ((db >= -16) & (db <= -6)).mean(), abs=0.0051)
    assert m["fused_structures_count"] == got["features"].count() and m["speckle_filter_applied"].endswith("(5x5)")


def test_second_images_of_another_size(spark):
    a, b = grids.synthetic(spark, "before", 48, 48), grids.synthetic(spark, "after", 24, 24)
    p = change.deltas(a, b, regrid=True).toPandas()
    assert len(p) == 48 * 48 and p["magnitude"].between(0, 3**0.5).all()
    o = grids.synthetic(spark, "coast", 40, 40).withColumn("scene_id", F.lit("radar"))
    assert radar.fuse(o, grids.synthetic(spark, "radar", 64, 64))["pixels"].count() == 1600


def regridded(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel by pixel: a triangle about the target's centre, as wide as a cell of the coarser grid."""

    def lines(n: int, to: int) -> np.ndarray:
        w = np.zeros((to, n))
        for t in range(to):
            centre, wide = (t + 0.5) * n / to, max(n / to, 1.0)
            w[t] = [max(0.0, 1 - abs(s + 0.5 - centre) / wide) for s in range(n)]
        return w / w.sum(axis=1, keepdims=True)

    return lines(a.shape[0], height) @ a @ lines(a.shape[1], width).T


def as_grid(df, value):
    p = df.toPandas()
    return {s: g.pivot(index="y", columns="x", values=value).to_numpy() for s, g in p.groupby("scene_id")}


@pytest.mark.parametrize("size", [(24, 24), (96, 70), (31, 100)])
def test_regridded_change_equals_a_plain_version(spark, size):
    """Larger, smaller and odd second dates, beside a scene that needs no regridding."""
    two = lambda kind, *sizes: [grids.synthetic(spark, kind, *hw).withColumn("scene_id", F.lit(f"s{i}")) for i, hw in enumerate(sizes)]
    before = functools.reduce(DataFrame.unionByName, two("before", (40, 36), (40, 36)))
    after = functools.reduce(DataFrame.unionByName, two("after", size, (40, 36)))
    views = [change.dated(d).view for d in (before, after)]
    got = change.deltas(before, after, regrid=True)
    found = {c: as_grid(got, c) for c in ("magnitude", "delta_index", "delta_brightness")}
    a, b = ({c: as_grid(v, c) for c in ("red", "green", "blue", "index")} for v in views)
    for s in ("s0", "s1"):
        old, new = [], []
        for c in ("red", "green", "blue"):
            fit = b[c][s] if b[c][s].shape == (40, 36) else np.floor(regridded(b[c][s], 40, 36) * 255 + 0.5 + 1e-9) / 255
            old.append(a[c][s])
            new.append(np.clip((fit - fit.mean()) * ((a[c][s].std() + 1e-6) / (fit.std() + 1e-6)) + a[c][s].mean(), 0, 1))
        index = b["index"][s] if b["index"][s].shape == (40, 36) else regridded(b["index"][s], 40, 36)
        off = np.array(new) - np.array(old)
        assert found["magnitude"][s] == pytest.approx(np.sqrt((off**2).sum(axis=0)), abs=1e-6)
        assert found["delta_brightness"][s] == pytest.approx(off.mean(axis=0), abs=1e-6)
        assert found["delta_index"][s] == pytest.approx(index - a["index"][s], abs=1e-6)


@pytest.mark.parametrize("size", [(64, 64), (20, 33)])
def test_regridded_radar_equals_a_plain_version(spark, size):
    optical, raw = grids.synthetic(spark, "coast", 40, 44).withColumn("scene_id", F.lit("radar")), grids.synthetic(spark, "radar", *size)
    smooth = radar.filtered(raw)
    db = as_grid(radar.fusion_pixels(optical, smooth, regrid=True), "db")["radar"]
    assert db == pytest.approx(regridded(as_grid(smooth, "filtered")["radar"], 40, 44), abs=1e-6)


def test_change_and_fusion(spark):
    a, b = (grids.synthetic(spark, n, 96, 96) for n in ("before", "after"))
    r = engine.detect_change(spark, a, b, COMPOUND).first()
    m = json.loads(r["metrics"])
    assert m["confidence_method"] == f"Dynamic Otsu separability criterion (η={m['otsu_separability_eta']}) with morphological cluster coherence"
    assert r["task_type"] == "CHANGE_DETECTION" and r["limitations"] and r["features"] and "zones" in r["answer"]
    o = grids.synthetic(spark, "coast", 64, 64).withColumn("scene_id", F.lit("radar"))
    f = engine.fuse(spark, o, grids.synthetic(spark, "radar", 64, 64)).first()
    assert json.loads(f["metrics"])["confidence_method"].startswith("Cross-modal correlation")
    assert f["task_type"] == "OPTICAL_SAR" and len(f["insights"]) == 3 and "backscatter" in f["answer"]
