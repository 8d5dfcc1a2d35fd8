"""The three analyses (3.1-3.3): from pixels and a question to a result row for each scene.

One plan treats all scenes of a table together. Pixels, features and metrics stay DataFrames; only the question, and
whether the scenes are few, are known to the driver.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intent import parse_one
from ..operators import bands, change, indices, radar
from ..operators.features import response_confidence
from ..operators.scenes import extents, few_scenes
from ..operators.steps import Steps
from ..schema import FEATURE, METADATA, PIXEL_SIZE, RESULT, STEP
from .providers import Clients, active, worded
from .registry import ground
from .report import answer

#: The tool of each step (fixed values).
TOOLS = {
    "step_query_parse": "query_parser", "step_raster_decode": "geotiff_decoder", "step_temporal_align": "temporal_aligner", "step_cva": "cva_detector", "step_ndvi_delta": "ndvi_analyzer",
    "step_builtup_gain": "builtup_analyzer", "step_spatial_intersection": "spatial_intersection", "step_change_grounding": "spatial_grounder", "step_sar_speckle": "sar_analyzer",
    "step_cross_modal_fusion": "multimodal_fusion", "step_ndvi": "ndvi_analyzer", "step_ndwi": "water_detector", "step_spatial_ground": "spatial_grounder", "step_vlm_synthesis": "vqa_reasoner",
}
METHODS = {
    "analysis": "Mean confidence of the features, from how densely they fill their boxes",
    "change": "Otsu separability of the change threshold",
    "fusion": "Mean confidence of the structures, from their filtered backscatter",
}


def _trace(steps: list[str], done: set[str], took: Steps) -> Column:
    """Planned steps, those that ran marked as completed, with the time that their own tables took to write and what
    was counted meanwhile; others pending (Q17). The answer is worded in the plan that gives the rows, so it has no time."""
    rows = [
        F.struct(
            F.lit(s).alias("step_id"), F.lit(s.removeprefix("step_").replace("_", " ")).alias("step_name"), F.lit(TOOLS[s]).alias("tool_name"), F.lit("completed" if s in done else "pending").alias("status"),
            F.lit(round(took.ms[s], 1) if s in done and s in took.ms else None).cast("double").alias("duration_ms"), F.lit(None).cast("string").alias("inputs_summary"), F.lit(took.summary(s)).alias("summary"), F.lit(None).cast("string").alias("evidence_generated"),
        )
        for s in steps
    ]
    return F.array(*rows).cast(f"array<{STEP.simpleString()}>")


def _gathered(features: DataFrame) -> DataFrame:
    """A scene's features, at most Rule.keep, in the order of their rank."""
    names = FEATURE.fieldNames()
    listed = F.array_sort(F.collect_list(F.struct("rank", *names)))
    return features.groupBy("scene_id").agg(F.transform(listed, lambda f: F.struct(*[f[n].alias(n) for n in names])).alias("features"))


def _metadata(pixels: DataFrame, extent: DataFrame, modality: str) -> DataFrame:
    """D4 of scenes that come as pixels alone."""
    names = bands.band_columns(pixels)
    known = {"width": F.col("width").cast("int"), "height": F.col("height").cast("int"), "channels": F.lit(len(names)), "has_nir": F.lit("nir" in names), "modality": F.lit(modality), "filename": F.col("scene_id"), "is_synthetic_fixture": F.lit(False)}
    return extent.select("scene_id", F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA]).alias("metadata"))


def _result(kind: str, prefix: str, scenes: DataFrame, parsed: dict, task: str, metrics: DataFrame, features: DataFrame, confidence: DataFrame, limitation: str | None, done: set[str], insights: DataFrame | None, started: float, took: Steps, clients: Clients | None) -> DataFrame:
    rows = scenes.join(metrics.select("scene_id", F.to_json(F.struct(*[c for c in metrics.columns if c != "scene_id"])).alias("metrics")), "scene_id", "left")
    rows = rows.join(_gathered(features), "scene_id", "left").join(confidence, "scene_id", "left")
    rows = rows.join(insights, "scene_id", "left") if insights is not None else rows.withColumn("insights", F.lit(None).cast("array<string>"))
    empty = F.array().cast(f"array<{FEATURE.simpleString()}>")
    rows = rows.withColumns({"features": F.coalesce("features", empty), "limitations": F.lit(limitation).cast("string"), "metrics": F.coalesce("metrics", F.lit("{}")), "query": F.lit(parsed["query"]), "task_type": F.lit(task)})
    rows = worded(rows, lambda: answer(F.lit(task)), active(rows.sparkSession, clients), clients)
    ms = round((time.time() - started) * 1000, 1)
    steps = parsed["steps"]
    made = {
        "analysis_id": F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.col("scene_id"), F.lit(uuid.uuid4().hex)), 256), 1, 8)), "kind": F.lit(kind), "query": F.col("query"), "answer": F.col("answer"), "task_type": F.col("task_type"),
        "confidence": F.col("confidence"), "confidence_method": F.when(F.col("confidence").isNotNull(), METHODS[kind]), "provider": F.col("provider"),
        "tools_planned": F.array(*[F.lit(TOOLS[s]) for s in steps]), "tools_used": F.array(*[F.lit(TOOLS[s]) for s in TOOLS if s in done]), "features": F.col("features"), "trace": _trace(steps, done, took),
        "metrics": F.col("metrics"), "insights": F.col("insights"), "limitations": F.col("limitations"), "execution_time_ms": F.lit(ms), "created_at": F.lit(time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())),
    }
    return rows.select("scene_id", *[made[f.name].cast(f.dataType).alias(f.name) for f in RESULT])


def analyze(spark: SparkSession, pixels: DataFrame, query: str, task_hint: str | None = None, size: float = PIXEL_SIZE, modality: str = "OPTICAL", strict: bool = True, clients: Clients | None = None) -> DataFrame:
    """3.1: a result for each scene of ``pixels`` (raw bands). The vegetation index is measured for greenery, spectra and
    scenes; water if asked for; the first target is always looked for, salient places where none is named."""
    started, took = time.time(), Steps()
    with took.timed("step_query_parse"):
        p = parse_one(spark, query, modality, task_hint)
    took.planned = p["steps"]
    with took.timed("step_raster_decode"):
        few = few_scenes(pixels)
        scaled = bands.normalise(pixels, few=few)
    parts, limits, done = [], [], {"step_query_parse", "step_raster_decode", "step_vlm_synthesis", "step_spatial_ground"}
    if p["requires_spectral"] or "vegetation" in p["target_features"] or p["primary_intent"] == "SCENE_DESCRIPTION":
        stats, limit = indices.vegetation_stats(scaled, size, few)
        parts.append(took.written(stats, "vegetation", "step_ndvi"))
        limits.append(limit)
        done.add("step_ndvi")
    if "water" in p["target_features"]:
        stats, limit = indices.water_stats(scaled, size)
        parts.append(took.written(stats, "water", "step_ndwi"))
        limits.append(limit)
        done.add("step_ndwi")
    target = p["target_features"][0] if p["target_features"] else "salient"
    with took.timed("step_spatial_ground"):
        found = ground(pixels, target, strict, size, few)
    metrics = found["stats"]
    for s in parts:
        metrics = metrics.join(s, "scene_id", "left")
    features = took.written(found["features"], "features", "step_spatial_ground")
    limitation = " ".join(dict.fromkeys(x for x in limits if x)) or None
    scenes = _metadata(pixels, extents(pixels), modality)
    return _result("analysis", "ans_", scenes, p, p["primary_intent"], metrics, features, response_confidence(features), limitation, done, None, started, took, clients)


def detect_change(spark: SparkSession, before: DataFrame, after: DataFrame, query: str = "What changed between the two images?", size: float = PIXEL_SIZE, clients: Clients | None = None) -> DataFrame:
    """3.2: a result for each scene that both dates have; the confidence is Otsu's separability."""
    started, took = time.time(), Steps()
    with took.timed("step_query_parse"):
        p = parse_one(spark, query, multitemporal=True)
    took.planned = p["steps"]
    with took.timed("step_raster_decode"):
        few = few_scenes(before)
    got = change.detect(before, after, query, size, few, steps=took)
    metrics = took.written(got["metrics"], "metrics", "step_change_grounding", "step_spatial_intersection")
    confidence = metrics.select("scene_id", F.bround("otsu_separability_eta", 2).alias("confidence"))
    scenes = _metadata(before, extents(before), "OPTICAL")
    return _result("change", "chg_", scenes, p, "CHANGE_DETECTION", metrics, got["features"], confidence, got["limitation"], set(p["steps"]), None, started, took, clients)


def fuse(spark: SparkSession, optical: DataFrame, radar_raw: DataFrame, query: str = "Compare the optical and the radar image.", size: float = PIXEL_SIZE, clients: Clients | None = None) -> DataFrame:
    """3.3: a result for each scene that both sensors have."""
    started, took = time.time(), Steps()
    with took.timed("step_query_parse"):
        p = parse_one(spark, query, "SAR", radar=True)
    took.planned = p["steps"]
    with took.timed("step_raster_decode"):
        few = few_scenes(optical)
    got = radar.fuse(optical, radar_raw, size, few, steps=took)
    scenes = _metadata(optical, extents(optical), "SAR")
    return _result("fusion", "sar_", scenes, p, "OPTICAL_SAR", got["metrics"], got["features"], response_confidence(got["features"]), None, set(p["steps"]), got["insights"], started, took, clients)
