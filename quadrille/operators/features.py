"""Features: geometry and attributes of the largest components."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..schema import PIXEL_SIZE, key_of
from .components import largest, sizes
from .overlay import BOX, overlapping
from .scenes import few_scenes
from .storage import written
from .sums import box_sums, tile_sums


@dataclass(frozen=True)
class Rule:
    """How many components a family keeps, of what size, and about how many vertices their outlines get."""

    keep: int
    share: float
    least: int
    vertices: int


GROUNDING = Rule(10, 0.001, 25, 24)
CHANGE = Rule(8, 0.002, 30, 20)
FUSION = Rule(6, 0.001, 20, 20)


def top_components(labels: DataFrame, extent: DataFrame, rule: Rule) -> DataFrame:
    return largest(sizes(labels), extent, rule.keep, rule.share, rule.least)


def fill_density(top: DataFrame, labels: DataFrame, few: bool | None = None) -> DataFrame:
    """A10: the share of each kept component's box that is set, by whatever component: four reads of a summed-area table
    of the set pixels. Boxes are few per scene (at most ``Rule.keep``); of few scenes they are broadcast to the tiles."""
    few = few_scenes(labels) if few is None else few
    boxes = written(top.select("scene_id", F.col("label").alias("box"), "ymin", "ymax", "xmin", "xmax"), "boxes")
    tiles = written(tile_sums(labels), "tiles")
    counts = box_sums(boxes, tiles, few).select("scene_id", F.col("box").alias("label"), "total")
    area = (F.col("ymax") - F.col("ymin")) * (F.col("xmax") - F.col("xmin"))
    return top.join(counts, ["scene_id", "label"]).withColumn("fill", F.col("total") / area).drop("total")


def measured(labels: DataFrame, pixels: DataFrame, counts: dict[str, Column], means: dict[str, Column] | None = None) -> DataFrame:
    """Of each component's pixels how many fulfil each condition, and means: rows (scene_id, label, ...).
    Conditions and values are those of ``pixels``, missing ones count as false."""
    key = [c for c in key_of(pixels.columns) if c in labels.columns]
    rows = labels.select(*key, "label").join(pixels.select(*key, *[c.alias(n) for n, c in (counts | (means or {})).items()]), key)
    return rows.groupBy("scene_id", "label").agg(*[F.count_if(F.coalesce(F.col(n), F.lit(False))).alias(n) for n in counts], *[F.avg(n).alias(n) for n in means or {}])


def outline_pixels(labels: DataFrame, top: DataFrame) -> DataFrame:
    """Pixels of the kept components with a 4-neighbour outside their own: a pixel is inner if all four moved copies
    of its component hit it."""
    own = labels.join(top.select("scene_id", "label"), ["scene_id", "label"])
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    moved = own.select("scene_id", "label", "y", "x", F.inline(steps)).select("scene_id", "label", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    inner = moved.groupBy("scene_id", "label", "y", "x").count().filter("count = 4").drop("count")
    return own.join(inner, ["scene_id", "label", "y", "x"], "left_anti")


def vertices(labels: DataFrame, top: DataFrame, most: int) -> DataFrame:
    """Outline pixels by angle around their mean (ties by y, x), every (n div most)-th, in shares of the scene.
    Rows (scene_id, label, place, y, x). One component's outline is ordered in one task: a perimeter, not an area."""
    edge = outline_pixels(labels, top)
    centre = edge.groupBy("scene_id", "label").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count(F.lit(1)).alias("n"))
    around = edge.join(centre, ["scene_id", "label"])
    order = W.partitionBy("scene_id", "label").orderBy(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")), "y", "x")
    placed = around.withColumn("place", F.row_number().over(order) - 1)
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    picked = placed.filter(F.col("place") % stride == 0).join(top.select("scene_id", "label", "height", "width"), ["scene_id", "label"])
    return picked.select("scene_id", "label", "place", F.bround(F.col("y") / F.col("height"), 4).alias("y"), F.bround(F.col("x") / F.col("width"), 4).alias("x"))


def polygons(labels: DataFrame, top: DataFrame, most: int) -> DataFrame:
    """A polygon (array of x, y) for each kept component, which always has an outline."""
    listed = F.array_sort(F.collect_list(F.struct("place", "x", "y")))
    made = vertices(labels, top, most).groupBy("scene_id", "label").agg(listed.alias("v"))
    return made.select("scene_id", "label", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("polygon"))


def geo_bounds(bounds: Column) -> Column:
    """A box's place on earth, between the scene's bounds; NULL without bounds."""
    wide, high = bounds["east"] - bounds["west"], bounds["north"] - bounds["south"]
    made = F.struct(
        F.bround(bounds["west"] + F.col("x0s") * wide, 6).alias("west"), F.bround(bounds["north"] - F.col("y1s") * high, 6).alias("south"),
        F.bround(bounds["west"] + F.col("x1s") * wide, 6).alias("east"), F.bround(bounds["north"] - F.col("y0s") * high, 6).alias("north"),
    )
    return F.when(bounds.isNotNull(), made)


def shaped(top: DataFrame) -> DataFrame:
    """Boxes in shares of the scene (y0s, x0s, y1s, x1s) and the quadrant of their centres."""
    made = top.withColumns({"y0s": F.col("ymin") / F.col("height"), "x0s": F.col("xmin") / F.col("width"), "y1s": F.col("ymax") / F.col("height"), "x1s": F.col("xmax") / F.col("width")})
    return made.withColumn("quadrant", px.quadrant((F.col("y0s") + F.col("y1s")) / 2, (F.col("x0s") + F.col("x1s")) / 2))


def as_features(shapes: DataFrame, polygon: DataFrame, ident: Column, label: Column, confidence: Column, properties: list[Column], size: float = PIXEL_SIZE, bounds: Column | None = None) -> DataFrame:
    """Rows of D7 with scene_id and rank. ``shapes`` comes from shaped(); properties become a JSON document."""
    bounds = F.lit(None).cast("struct<west:double,south:double,east:double,north:double>") if bounds is None else bounds
    area = px.hectares(F.col("pixels"), size)
    crs = F.when(bounds.isNotNull(), "EPSG:4326").otherwise("Image Pixel Space").alias("coordinate_reference")
    return shapes.join(polygon, ["scene_id", "label"]).select(
        "scene_id", "rank", ident.alias("id"), F.format_string("%s (%s)", label, F.col("quadrant")).alias("label"),
        *[F.bround(c, 4).alias(n) for c, n in (("y0s", "ymin"), ("x0s", "xmin"), ("y1s", "ymax"), ("x1s", "xmax"))],
        "polygon", confidence.alias("confidence"), F.when(area > 0.01, area).alias("area_hectares"),
        F.struct(F.col("ymin").alias("ymin_px"), F.col("xmin").alias("xmin_px"), F.col("ymax").alias("ymax_px"), F.col("xmax").alias("xmax_px")).alias("pixel_bounds"),
        geo_bounds(bounds).alias("geo_bounds"), F.to_json(F.struct(*properties, crs)).alias("properties"),
    )


def grounded(labels: DataFrame, extent: DataFrame, name: str, size: float = PIXEL_SIZE, bounds: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Features of a cleaned mask's components, and A4: coverage by all of its pixels, not the kept ones alone."""
    top = top_components(labels, extent, GROUNDING)
    shapes = shaped(fill_density(top, labels))
    properties = [F.col("pixels").alias("pixel_count"), F.col("quadrant"), F.bround("fill", 3).alias("fill_density"), F.size("polygon").alias("vertex_count")]
    ident = F.format_string("feat_%s_%d", F.lit(name.lower().replace(" ", "_")), F.col("rank"))
    found = as_features(shapes, polygons(labels, top, GROUNDING.vertices), ident, F.lit(name), px.grounding_confidence(F.col("fill")), properties, size, bounds)
    total = labels.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    kept = top.groupBy("scene_id").agg(F.count(F.lit(1)).alias("kept"))
    n = F.coalesce("n", F.lit(0))
    stats = extent.join(total, "scene_id", "left").join(kept, "scene_id", "left").select(
        "scene_id", F.lit(name).alias("feature_label"), F.coalesce("kept", F.lit(0)).alias("detected_clusters"), F.bround(n / (F.col("height") * F.col("width")) * 100, 2).alias("coverage_percentage"),
        px.hectares(n, size).alias("total_area_hectares"), n.alias("total_pixels"),
    )
    return found, stats


def response_confidence(features: DataFrame, scenes: DataFrame | None = None) -> DataFrame:
    """The mean confidence of a scene's features in hundredths, halves up; the mean is one of decimals, so the order
    of its sum decides no half. Of ``scenes`` (column scene_id) each has a row, NULL where it has no features; without
    them only scenes with features have one."""
    mean = F.round(F.avg(F.col("confidence").cast("decimal(20,10)")), 2).cast("double")
    found = features.groupBy("scene_id").agg(mean.alias("confidence"))
    return found if scenes is None else scenes.select("scene_id").distinct().join(found, "scene_id", "left")


def spatial_intersection(features: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """The features of a compound transition. With ``other``, those that overlap one of its features in the same
    scene, by their polygons; boxes meet in the cells of a grid, so a scene of many features is spread over tasks."""
    if other is None:
        return features.filter(F.get_json_object("properties", "$.is_compound_transition") == "true")
    shape = lambda df: df.select("scene_id", "id", *BOX, *[c for c in ("polygon",) if c in df.columns])
    met = overlapping(shape(features), shape(other)).select("scene_id", F.col("a.id").alias("id")).distinct()
    return features.join(met, ["scene_id", "id"], "left_semi")
