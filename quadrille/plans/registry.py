"""The tools by name (2.10): functions over DataFrames, described and looked up, and the state of the whole."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands, change, features, indices, masks, neighbours, radar
from ..operators.components import components
from ..operators.resample import resample
from ..operators.scenes import extents
from ..operators.storage import written
from ..sources import raster
from .providers import Clients, active, mode
from .report import answer

OPTICAL, ALL = ["OPTICAL", "MULTISPECTRAL"], ["OPTICAL", "MULTISPECTRAL", "SAR"]


@dataclass(frozen=True)
class Tool:
    name: str
    category: str
    inputs: list[str]
    output: str
    modalities: list[str]
    run: Callable[..., Any] | None = None


@dataclass
class Registry:
    tools: dict[str, Tool] = field(default_factory=dict)

    def register(self, tool: Tool) -> None:
        self.tools[tool.name] = tool

    def get(self, name: str) -> Tool | None:
        return self.tools.get(name)

    def execute(self, name: str, **inputs: Any) -> Any:
        """The tool's DataFrames, not yet run. An unknown name is a KeyError, a tool without a function cannot be run."""
        tool = self.tools[name]
        if tool.run is None:
            raise NotImplementedError(name)
        return tool.run(**inputs)

    def listed(self, spark: SparkSession) -> DataFrame:
        """S21."""
        rows = [(t.name, t.category, t.inputs, t.output, t.modalities, t.run is not None) for t in self.tools.values()]
        return spark.createDataFrame(rows, "name string, category string, inputs array<string>, output string, modalities array<string>, runnable boolean")


def ground(pixels: DataFrame, feature: str, strict: bool = True, size: float = 10.0, few: bool | None = None, threshold: float | None = None) -> dict[str, DataFrame]:
    """Mask, clean-up, components and features of one kind of thing. ``strict`` keeps the rule by which built_up is
    looked for as salient."""
    kind = masks.kind_of(feature, strict)
    clean = written(neighbours.cleaned(masks.mask(pixels, kind, few, threshold)), "mask")
    labels = written(components(clean), "labels")
    found, stats = features.grounded(labels, extents(pixels), masks.LABELS[kind], size)
    return {"mask": clean, "labels": labels, "features": found, "stats": stats}


def aligned(before: DataFrame, after: DataFrame, values: list[str]) -> DataFrame:
    """``after`` on the grid of ``before``; grids begin at 0."""
    return resample(after, extents(before).select("scene_id", "height", "width"), values)


def standard() -> Registry:
    """The fourteen tools (fixed names)."""
    r = Registry()
    for t in (
        Tool("geotiff_decoder", "Raster Processing", ["files"], "pixels", ALL, lambda files: raster.pixels(files)),
        Tool("metadata_analyzer", "Geospatial Analysis", ["files"], "metadata", ALL, lambda files: raster.heads(files)),
        Tool("ndvi_analyzer", "Spectral Analysis", ["pixels"], "index statistics", OPTICAL, lambda pixels: indices.vegetation_stats(bands.normalise(pixels))),
        Tool("water_detector", "Spectral Analysis", ["pixels"], "water statistics", OPTICAL, lambda pixels: indices.water_stats(bands.normalise(pixels))),
        Tool("spatial_grounder", "Computer Vision", ["pixels", "feature"], "features", OPTICAL, ground),
        Tool("change_detector", "Temporal Analysis", ["before", "after", "query"], "features and metrics", OPTICAL, change.detect),
        Tool("optical_analyzer", "Optical Processing", ["pixels"], "summary", OPTICAL, lambda pixels: bands.optical_summary(pixels)),
        Tool("sar_analyzer", "SAR Processing", ["pixels", "k"], "filtered decibels", ["SAR"], lambda pixels, k=radar.WINDOW: radar.filtered(pixels, k=k)),
        Tool("multimodal_fusion", "Multimodal Reasoning", ["optical", "radar_raw"], "features and metrics", ALL, radar.fuse),
        Tool("vqa_reasoner", "Vision-Language AI", ["rows"], "answer", ALL, lambda rows: rows.withColumn("answer", answer(F.col("task_type")))),
        Tool("temporal_aligner", "Temporal Analysis", ["before", "after", "values"], "pixels", OPTICAL, aligned),
        Tool("cva_detector", "Temporal Analysis", ["before", "after", "query"], "features and metrics", OPTICAL, change.detect),
        Tool("builtup_analyzer", "Computer Vision", ["pixels"], "features", OPTICAL, lambda pixels, strict=True: ground(pixels, "built_up", strict)),
        Tool("spatial_intersection", "Geospatial Analysis", ["features", "other"], "features", ALL, features.spatial_intersection),
    ):
        r.register(t)
    return r


def health(spark: SparkSession, clients: Clients | None = None) -> DataFrame:
    """One row of what answers and which tools there are."""
    now, tools = active(spark, clients), list(standard().tools)
    return spark.createDataFrame([("online", now, mode(now), len(tools), tools)], "status string, provider string, mode string, tool_count int, tools array<string>")
