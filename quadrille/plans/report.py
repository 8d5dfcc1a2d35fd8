"""Text of an answer from metrics and features (R3), as expressions over one row for each scene.

Metrics that are missing or zero leave their sentence out; the wording is the library's own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Features that a sentence names.
NAMED = 4


def _m(metrics: str, name: str) -> Column:
    return F.try_variant_get(F.try_parse_json(F.col(metrics)), f"$.{name}", "double") if hasattr(F, "try_variant_get") else F.get_json_object(metrics, f"$.{name}").cast("double")


def _number(c: Column) -> Column:
    return F.regexp_replace(F.format_number(c, 2), ",", "")


def _join(*lines: Column) -> Column:
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def _feature(f: Column) -> Column:
    area = F.when(f["area_hectares"].isNotNull(), F.concat(F.lit(", about "), f["area_hectares"].cast("string"), F.lit(" ha"))).otherwise("")
    sure = F.when(f["confidence"].isNotNull(), F.concat(F.lit(", confidence "), F.floor(f["confidence"] * 100 + 1e-9).cast("string"), F.lit("%"))).otherwise("")
    box = F.array_join(F.transform(F.array(f["ymin"], f["xmin"], f["ymax"], f["xmax"]), _number), ", ")
    corners = F.when(F.size(f["polygon"]) > 0, F.concat(F.lit(" with "), F.size(f["polygon"]).cast("string"), F.lit(" vertices"))).otherwise("")
    return F.concat(F.lit("- "), f["label"], F.lit(" at ["), box, F.lit("]"), corners, area, sure)


def _all(features: str) -> Column:
    return F.array_join(F.transform(features, _feature), "\n")


def answer(task: Column, metrics: str = "metrics", features: str = "features", limitation: str = "limitations", metadata: str = "metadata") -> Column:
    """The answer by task. ``metrics`` is a JSON document, ``features`` an array of D7, ``metadata`` a struct of D4."""
    m = lambda n: _m(metrics, n)
    n = F.size(features)
    meta = F.col(metadata)
    some = n > 0
    size = F.concat(meta["width"].cast("string"), F.lit(" by "), meta["height"].cast("string"))
    named = F.array_join(F.transform(F.slice(features, 1, NAMED), lambda f: F.concat(f["label"], F.lit(" ("), F.coalesce(f["area_hectares"].cast("string"), F.lit("n/a")), F.lit(" ha)"))), ", ")
    scene = _join(
        F.concat(F.lit("Scene: "), size, F.lit(" pixels, "), meta["modality"], F.lit(", "), meta["channels"].cast("string"), F.lit(" channels.")),
        F.when(meta["has_nir"], "Near infrared is there, so vegetation is measured.").otherwise("Only visible bands are there."),
        F.when(some, F.concat(F.lit("Most prominent: "), named, F.lit("."))),
        F.when(m("mean_ndvi").isNotNull(), F.concat(F.lit("Vegetation: mean NDVI "), _number(m("mean_ndvi")), F.lit(", median "), _number(F.coalesce(m("median_ndvi"), F.lit(0.0))), F.lit(", peak "), _number(F.coalesce(m("max_ndvi"), F.lit(0.0))), F.lit("; "), _number(F.coalesce(m("total_vegetation_pct"), F.lit(0.0))), F.lit("% of the valid surface is green.")))
        .when(m("estimated_vegetation_pct").isNotNull(), F.concat(F.lit("Vegetation: about "), _number(m("estimated_vegetation_pct")), F.lit("% looks green ("), _number(F.coalesce(m("estimated_vegetation_hectares"), F.lit(0.0))), F.lit(" ha)."))),
        F.when(m("water_coverage_pct") > 0, F.concat(F.lit("Water: "), _number(m("water_coverage_pct")), F.lit("% of the scene ("), _number(F.coalesce(m("water_area_hectares"), F.lit(0.0))), F.lit(" ha)."))),
    )
    kind = F.get(F.split(F.get(F.col(features), 0)["label"], r" \("), 0)
    ground = _join(
        F.when(some, F.concat(n.cast("string"), F.lit(" clusters of "), kind, F.lit(":"))).otherwise("Nothing of that kind stands out above the threshold."),
        F.when(some, _all(features)),
        F.when(some & (m("total_area_hectares") > 0), F.concat(F.lit("Together about "), _number(m("total_area_hectares")), F.lit(" ha."))),
        F.when(m("mean_ndvi").isNotNull(), F.concat(F.lit("Mean NDVI of the scene: "), _number(m("mean_ndvi")), F.lit("."))),
    )
    change = _join(
        F.concat(F.lit("Changed: "), _number(F.coalesce(m("total_change_pct"), F.lit(0.0))), F.lit("% of the scene"), F.when(m("total_changed_hectares") > 0, F.concat(F.lit(", about "), _number(m("total_changed_hectares")), F.lit(" ha"))).otherwise(""), F.lit(".")),
        F.when(m("builtup_expansion_pct") > 0, F.concat(F.lit("- built up: "), _number(m("builtup_expansion_pct")), F.lit("%, brighter than before"))),
        F.when(m("vegetation_loss_pct") > 0, F.concat(F.lit("- vegetation lost: "), _number(m("vegetation_loss_pct")), F.lit("%, less green than before"))),
        F.when(m("water_fluctuation_pct") > 0, F.concat(F.lit("- water or shore: "), _number(m("water_fluctuation_pct")), F.lit("%"))),
        F.when(some, F.concat(n.cast("string"), F.lit(" zones:\n"), _all(features))),
        F.when(m("otsu_separability_eta").isNotNull(), F.concat(F.lit("Otsu separability of the threshold: "), _number(m("otsu_separability_eta")), F.lit("."))),
    )
    radar = _join(
        F.concat(F.lit("Radar: mean backscatter "), _number(F.coalesce(m("mean_backscatter_db"), F.lit(-12.0))), F.lit(" dB after filtering; "), _number(F.coalesce(m("metallic_builtup_scatter_pct"), F.lit(0.0))), F.lit("% returns strongly, "), _number(F.coalesce(m("calm_water_specular_pct"), F.lit(0.0))), F.lit("% is smooth.")),
        F.when(some, F.concat(n.cast("string"), F.lit(" structures that both sensors see:\n"), F.array_join(F.transform(features, lambda f: F.concat(F.lit("- "), f["label"])), "\n"))),
    )
    other = F.concat(F.lit("The scene of "), size, F.lit(" pixels was measured; figures and features are attached."))
    text = F.when(task == "SCENE_DESCRIPTION", scene).when(task.isin("SPATIAL_GROUNDING", "SPECTRAL_WATER", "SPECTRAL_VEGETATION"), ground).when(task == "CHANGE_DETECTION", change).when(task == "OPTICAL_SAR", radar).otherwise(other)
    return F.concat(text, F.when(F.col(limitation).isNotNull(), F.concat(F.lit("\nLimitation: "), F.col(limitation))).otherwise(""))
