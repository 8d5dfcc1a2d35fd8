"""What a question asks for (R1, R2), as expressions over a column of questions: they run on tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Substrings by group (fixed values). Substrings misfire now and then, as "port" in "report"; that is kept.
TEMPORAL = ["change", "between", "earlier", "later", "before", "after", "two dates", "evolution", "decreased", "increased"]
GREEN = ["vegetation", "crop", "forest", "farm", "green", "tree", "plant", "ndvi"]
BUILT = ["built", "urban", "construction", "development", "building", "structure"]
RADAR = ["sar", "radar", "backscatter", "microwave", "sentinel-1", "dielectric"]
LOCATE = ["where", "find", "locate", "show", "detect", "highlight", "identify", "pinpoint"]
VEGETATION = [*GREEN, "agricultural"]
WATER = ["water", "river", "lake", "ocean", "sea", "canal", "reservoir", "ndwi", "flood", "bay", "coastal"]
BUILT_FEATURE = ["urban", "city", "building", "structure", "built-up", "construction", "road", "port", "facility"]
DESCRIBE = ["describe", "what do you see", "what is visible", "overview", "caption", "tell me about", "what is in"]
COVER = ["land cover", "land use", "types of land", "classes"]

#: Steps by branch (fixed values).
FIRST = ["step_query_parse", "step_raster_decode"]
COMPOUND_STEPS = ["step_temporal_align", "step_cva", "step_ndvi_delta", "step_builtup_gain", "step_spatial_intersection"]
CHANGE_STEPS = ["step_temporal_align", "step_cva", "step_change_grounding"]
RADAR_STEPS = ["step_sar_speckle", "step_cross_modal_fusion"]
LAST = ["step_vlm_synthesis"]


def has(q: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(q, w))


def _listed(*parts: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, name) for c, name in parts]), lambda x: x.isNotNull())


def parsed(df: DataFrame, query: str = "query", modality: Column | str = "OPTICAL") -> DataFrame:
    """``df`` with intents (in order of priority), primary_intent, target_features and what is required. Null questions
    count as empty."""
    q = F.trim(F.lower(F.coalesce(query, F.lit(""))))
    flags = {"temporal": TEMPORAL, "green": GREEN, "built": BUILT, "radar": RADAR, "locate": LOCATE, "veg": VEGETATION, "wet": WATER, "town": BUILT_FEATURE, "describe": DESCRIBE, "cover": COVER}
    out = df.withColumn("_is", F.struct(*[has(q, words).alias(n) for n, words in flags.items()]))
    is_ = lambda n: F.col(f"_is.{n}")
    both = is_("temporal") & is_("green") & is_("built")
    intents = _listed((both, "COMPOUND_CHANGE"), (is_("temporal"), "CHANGE_DETECTION"), (is_("radar"), "OPTICAL_SAR"), (is_("locate"), "SPATIAL_GROUNDING"), (is_("veg"), "SPECTRAL_VEGETATION"), (is_("wet"), "SPECTRAL_WATER"), (is_("describe"), "SCENE_DESCRIPTION"), (is_("cover"), "LAND_COVER"))
    targets = _listed((both, "vegetation_loss"), (both, "builtup_gain"), (is_("veg"), "vegetation"), (is_("wet"), "water"), (is_("town"), "built_up"))
    out = out.withColumns({"_intents": intents, "target_features": targets})
    fallback = F.array(F.when(F.size("target_features") > 0, "SPATIAL_GROUNDING").otherwise("SCENE_DESCRIPTION"))
    out = out.withColumn("intents", F.when(F.size("_intents") > 0, F.col("_intents")).otherwise(fallback))
    of = lambda n: F.array_contains("intents", n)
    mode = modality if isinstance(modality, Column) else F.lit(modality)
    return out.withColumns({
        "primary_intent": F.element_at("intents", 1),
        "requires_grounding": of("SPATIAL_GROUNDING") | (F.size("target_features") > 0),
        "requires_spectral": of("SPECTRAL_VEGETATION") | of("SPECTRAL_WATER"),
        "requires_change": of("CHANGE_DETECTION"),
        "requires_sar": of("OPTICAL_SAR") | (mode == "SAR"),
    }).drop("_is", "_intents")


def hinted(df: DataFrame, hint: Column | str | None) -> DataFrame:
    """A hint takes the place of the primary intent and of nothing else."""
    if hint is None:
        return df
    h = hint if isinstance(hint, Column) else F.lit(hint)
    return df.withColumn("primary_intent", F.coalesce(h, F.col("primary_intent")))


def planned(df: DataFrame, multitemporal: bool = False, radar: bool = False) -> DataFrame:
    """R2: a parsed table with the array ``steps``."""
    words = lambda names: F.array(*[F.lit(n) for n in names])
    p = F.col("primary_intent")
    of = lambda n: F.array_contains("intents", n)
    single = _listed((F.col("requires_spectral") | of("SPECTRAL_VEGETATION"), "step_ndvi"), (of("SPECTRAL_WATER"), "step_ndwi"), (F.col("requires_grounding"), "step_spatial_ground"))
    branch = F.when(p == "COMPOUND_CHANGE", words(COMPOUND_STEPS)).when(F.lit(multitemporal) | (p == "CHANGE_DETECTION"), words(CHANGE_STEPS)).when(F.lit(radar) | (p == "OPTICAL_SAR"), words(RADAR_STEPS)).otherwise(single)
    return df.withColumn("steps", F.concat(words(FIRST), branch, words(LAST)))


def parse_one(spark: SparkSession, query: str, modality: str = "OPTICAL", hint: str | None = None, multitemporal: bool = False, radar: bool = False) -> dict:
    """One question's parsed row; the same expressions over a local row."""
    one = spark.createDataFrame([(query,)], "query string")
    return planned(hinted(parsed(one, modality=modality), hint), multitemporal, radar).first().asDict()
