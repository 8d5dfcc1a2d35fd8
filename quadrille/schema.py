"""Schemas of the tables and result documents."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructType,
)

#: What tells a pixel from all others; scenes are processed together, so every operator keeps to these.
KEY = ["scene_id", "y", "x"]
#: The tile of a pixel, in tables that are kept by tile.
TILE_KEY = ["tile_y", "tile_x"]
#: Metres per pixel where the metadata has none.
PIXEL_SIZE = 10.0


def key_of(columns: list[str]) -> list[str]:
    """KEY, and the tile where the columns have it: joins that name it too can follow the way tables are kept."""
    return KEY + [c for c in TILE_KEY if c in columns]


POINT = StructType().add("x", DoubleType()).add("y", DoubleType())
PIXEL_BOUNDS = StructType().add("ymin_px", LongType()).add("xmin_px", LongType()).add("ymax_px", LongType()).add("xmax_px", LongType())
GEO_BOUNDS = StructType().add("west", DoubleType()).add("south", DoubleType()).add("east", DoubleType()).add("north", DoubleType())
#: D7; ``properties`` are the operator's own, as JSON.
FEATURE = (
    StructType()
    .add("id", StringType())
    .add("label", StringType())
    .add("ymin", DoubleType())
    .add("xmin", DoubleType())
    .add("ymax", DoubleType())
    .add("xmax", DoubleType())
    .add("polygon", ArrayType(POINT))
    .add("confidence", DoubleType())
    .add("area_hectares", DoubleType())
    .add("pixel_bounds", PIXEL_BOUNDS)
    .add("geo_bounds", GEO_BOUNDS)
    .add("properties", StringType())
)
#: D4, with the place of each band by name.
METADATA = (
    StructType()
    .add("filename", StringType())
    .add("format", StringType())
    .add("width", IntegerType())
    .add("height", IntegerType())
    .add("channels", IntegerType())
    .add("band_names", ArrayType(StringType()))
    .add("has_nir", BooleanType())
    .add("modality", StringType())
    .add("crs", StringType())
    .add("bounds", GEO_BOUNDS)
    .add("transform", ArrayType(DoubleType()))
    .add("pixel_size_meters", DoubleType())
    .add("data_type", StringType())
    .add("nodata_value", DoubleType())
    .add("sensor_name", StringType())
    .add("acquisition_date", StringType())
    .add("is_synthetic_fixture", BooleanType())
    .add("band_map", MapType(StringType(), IntegerType()))
)
#: D9; the picture itself is a column, not a file behind an address.
EVIDENCE = (
    StructType()
    .add("id", StringType())
    .add("layer_type", StringType())
    .add("title", StringType())
    .add("description", StringType())
    .add("default_opacity", DoubleType())
    .add("legend", StringType())
    .add("statistics", MapType(StringType(), StringType()))
    .add("png", BinaryType())
)
#: D10.
STEP = (
    StructType()
    .add("step_id", StringType())
    .add("step_name", StringType())
    .add("tool_name", StringType())
    .add("status", StringType())
    .add("duration_ms", DoubleType())
    .add("inputs_summary", StringType())
    .add("summary", StringType())
    .add("evidence_generated", StringType())
)
#: D11 as a row: lists are arrays, metrics are one JSON document.
RESULT = (
    StructType()
    .add("analysis_id", StringType())
    .add("kind", StringType())
    .add("query", StringType())
    .add("answer", StringType())
    .add("task_type", StringType())
    .add("confidence", DoubleType())
    .add("confidence_method", StringType())
    .add("provider", StringType())
    .add("tools_planned", ArrayType(StringType()))
    .add("tools_used", ArrayType(StringType()))
    .add("features", ArrayType(FEATURE))
    .add("trace", ArrayType(STEP))
    .add("metrics", StringType())
    .add("insights", ArrayType(StringType()))
    .add("limitations", StringType())
    .add("execution_time_ms", DoubleType())
    .add("created_at", StringType())
)
#: Columns of a band map by channel count (fixed values): the first bands of a scene.
BANDS = ["red", "green", "blue", "nir"]


def default_bands(channels: int) -> dict[str, int]:
    """Band name to channel for a scene of so many channels."""
    if channels >= 4:
        return {name: i for i, name in enumerate(BANDS)}
    if channels >= 3:
        return {name: i for i, name in enumerate(BANDS[:3])}
    return {"red": 0}
