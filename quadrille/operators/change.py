"""Change between two dates of a scene.

Both dates have the same scene_id. The join on pixels is the only wide shuffle of pixels; statistics of scenes are rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..functions.intent import has
from ..schema import KEY, PIXEL_SIZE, key_of
from .bands import band_columns, nir_of, normalise, rgb_view
from .components import components
from .features import CHANGE, as_features, fill_density, measured, polygons, shaped, top_components
from .indices import _count
from .neighbours import cleaned
from .resample import resample
from .scenes import attach, band_statistics, extents, few_scenes, share
from .steps import Steps
from .storage import written

VISIBLE = ["red", "green", "blue"]
BINS = 256
LEAST_THRESHOLD = 0.22
NO_NIR = "At least one date has no near-infrared band: vegetation change is read from visible bands, and seasons or crop rotation may show up as change."


def moments(df: DataFrame, bands: list[str] = VISIBLE) -> DataFrame:
    """Mean and deviation of each band: a row for each scene with ``mu_<band>`` and ``sd_<band>``."""
    return df.groupBy("scene_id").agg(*[f(b).alias(f"{n}_{b}") for b in bands for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])


def matched(before: DataFrame, after: DataFrame, bands: list[str] = VISIBLE, few: bool | None = None) -> DataFrame:
    """``after`` with each band's mean and deviation brought to those of ``before``, and clipped to [0, 1]."""
    return brought(after, moments(before, bands), moments(after, bands), bands, few)


def brought(after: DataFrame, to: DataFrame, own: DataFrame, bands: list[str] = VISIBLE, few: bool | None = None) -> DataFrame:
    """matched() from moments that are known."""
    tagged = [m.withColumnsRenamed({f"{n}_{b}": f"{n}_{b}_{tag}" for b in bands for n in ("mu", "sd")}) for m, tag in ((to, "a"), (own, "b"))]
    rows = attach(after, tagged[0].join(tagged[1], "scene_id"), few)
    sd = lambda b, tag: F.col(f"sd_{b}_{tag}") + px.EPS
    new = {b: px.clip((F.col(b) - F.col(f"mu_{b}_b")) * (sd(b, "a") / sd(b, "b")) + F.col(f"mu_{b}_a"), 0, 1) for b in bands}
    return rows.withColumns(new).select(*after.columns)


def aligned(df: DataFrame, raw: DataFrame, target: DataFrame, values: list[str]) -> DataFrame:
    """``df`` with the scenes that are of another size than in ``target`` brought to that one's grid; the others, which
    a count of sizes tells, and those that ``target`` has not, stay as they are. ``raw`` is the table of which ``df`` is
    a view: sizes are taken from it."""
    own, want = extents(raw), extents(target).select("scene_id", F.col("height").alias("to_height"), F.col("width").alias("to_width"))
    sizes = written(own.join(want, "scene_id").select("scene_id", "to_height", "to_width", ((F.col("height") != F.col("to_height")) | (F.col("width") != F.col("to_width"))).alias("odd")), "sizes")
    odd = sizes.filter("odd").select("scene_id", F.col("to_height").alias("height"), F.col("to_width").alias("width"))
    if not odd.limit(1).count():
        return df
    rest = df.join(odd.select("scene_id"), "scene_id", "left_anti").select(*KEY, *values)
    return rest.unionByName(resample(df.join(odd.select("scene_id"), "scene_id", "left_semi"), odd, values))


def unit_view(df: DataFrame, few: bool | None = None) -> DataFrame:
    return rgb_view(df, few).withColumns({b: F.col(b) / 255.0 for b in VISIBLE})


def magnitude(a: str = "a", b: str = "b") -> Column:
    """The length of a pixel's change vector."""
    parts = [(F.col(f"{b}.{c}") - F.col(f"{a}.{c}")) * (F.col(f"{b}.{c}") - F.col(f"{a}.{c}")) for c in VISIBLE]
    return F.sqrt(parts[0] + parts[1] + parts[2])


def brightness(side: str) -> Column:
    return (F.col(f"{side}.red") + F.col(f"{side}.green") + F.col(f"{side}.blue")) / 3


def index_of(df: DataFrame, few: bool | None = None) -> DataFrame:
    """The vegetation index from raw bands; without data it counts as 0."""
    scaled = normalise(df, few=few)
    return scaled.select(*KEY, F.coalesce(px.vegetation_index("red", "green", "blue", nir_of(df)), F.lit(0.0)).alias("index"))


class Dated(NamedTuple):
    """A date's pixels with red, green and blue of the view, from 0 to 1, and the index; and the moments of the view, if
    they are known without reading the pixels again."""

    view: DataFrame
    moments: DataFrame | None


def dated(df: DataFrame, few: bool | None = None) -> Dated:
    """One date, read twice: for the statistics of its bands and for its pixels. Of whole-number bands the first reading
    makes a value histogram, from which extremes, percentiles and the moments of the stretched view all follow."""
    few = few_scenes(df) if few is None else few
    have, every = [b for b in VISIBLE if b in df.columns], band_columns(df)
    found, counts = band_statistics(df, every, [0.02, 0.98], few)
    view = lambda b, v: px.stretched(v, F.col(f"{b}_q0"), F.col(f"{b}_q1"), F.col(f"low_{b}"), F.col(f"high_{b}")) / 255.0
    shown = {b: b if b in have else have[0] for b in VISIBLE}
    known = None
    if counts is not None:
        shade = None
        for b in have:
            shade = (F if shade is None else shade).when(F.col("name") == b, view(b, "v"))
        rows = attach(counts.filter(F.col("name").isin(have)), found, few).select("scene_id", "name", "n", shade.alias("w"))
        per = rows.groupBy("scene_id", "name").agg(F.sum("n").alias("total"), F.sum(F.col("w") * F.col("n")).alias("mu"), F.sum(F.col("w") * F.col("w") * F.col("n")).alias("square"))
        per = per.select("scene_id", "name", (F.col("mu") / F.col("total")).alias("mu"), (F.col("square") / F.col("total")).alias("square"))
        per = per.withColumn("sd", F.sqrt(F.greatest(F.col("square") - F.col("mu") * F.col("mu"), F.lit(0.0))))
        known = per.groupBy("scene_id").agg(*[F.max(F.when(F.col("name") == shown[b], F.col(n))).alias(f"{n}_{b}") for b in VISIBLE for n in ("mu", "sd")])
    scaled = {f"of_{b}": px.normalised(b, F.col(f"high_{b}")) for b in every}
    index = px.vegetation_index("of_red", "of_green", "of_blue", "of_nir" if nir_of(df) else None)
    key = key_of(df.columns)
    made = attach(df, found, few).withColumns(scaled).select(*key, *[view(b, b).alias(b) for b in have], F.coalesce(index, F.lit(0.0)).alias("index"))
    return Dated(made.select(*key, *[F.col(shown[b]).alias(b) for b in VISIBLE], "index"), known)


def deltas(before: DataFrame, after: DataFrame, few: bool | None = None, regrid: bool = False) -> DataFrame:
    """Pixels that both dates have, with magnitude, delta_index and delta_brightness. With ``regrid`` a second date
    of another size is brought to the grid of the first (J10); its view then has whole steps of 255 again. Dates that
    are kept by tile (save_by_tile) meet without a shuffle of pixels."""
    a, b = dated(before, few), dated(after, few)
    on_grid = aligned(b.view, after, before, [*VISIBLE, "index"]) if regrid else b.view
    if on_grid is not b.view:
        # Halves go up, those that the order of a sum leaves a little short too.
        b = Dated(on_grid.withColumns({c: F.floor(F.col(c) * 255 + (0.5 + 1e-9)) / 255.0 for c in VISIBLE}), None)
    known = [moments(d.view) if d.moments is None else d.moments for d in (a, b)]
    both = a.view.alias("a").join(brought(b.view, *known, few=few).alias("b"), [c for c in key_of(a.view.columns) if c in b.view.columns])
    return both.select(*KEY, magnitude().alias("magnitude"), (F.col("b.index") - F.col("a.index")).alias("delta_index"), (brightness("b") - brightness("a")).alias("delta_brightness"))


def histogram(df: DataFrame, value: str, few: bool | None = None, bins: int = BINS) -> DataFrame:
    """Counts of ``bins`` equal bins from 0 to the scene's greatest value and a little more, empty ones included."""
    top = df.groupBy("scene_id").agg((F.max(value) + 1e-4).alias("top"))
    counts = attach(df.select("scene_id", value), top, few).groupBy("scene_id", F.least(F.floor(F.col(value) / F.col("top") * bins), F.lit(bins - 1)).cast("int").alias("bin")).count()
    spine = top.select("scene_id", "top", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(counts, ["scene_id", "bin"], "left").select("scene_id", "top", "bin", F.coalesce("count", F.lit(0)).alias("n"))


def otsu(df: DataFrame, value: str = "magnitude", few: bool | None = None, bins: int = BINS) -> DataFrame:
    """Threshold, the first bin that parts best, its separability eta, and the threshold in use: at least
    the mean and 1.2 deviations, and LEAST_THRESHOLD. The windows run over the bins of a scene, not over its pixels."""
    h = histogram(df, value, few, bins)
    moments = df.groupBy("scene_id").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.var_pop(value).alias("var"))
    all_bins = W.partitionBy("scene_id")
    upto = all_bins.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    p = F.col("n") / F.sum("n").over(all_bins)
    centre = (F.col("bin") + 0.5) * F.col("top") / bins
    run = h.withColumns({"p": p, "centre": centre}).withColumns({"omega": F.sum("p").over(upto), "mu": F.sum(F.col("p") * F.col("centre")).over(upto), "mu_t": F.sum(F.col("p") * F.col("centre")).over(all_bins)})
    apart = F.col("mu_t") * F.col("omega") - F.col("mu")
    run = run.withColumn("between", apart * apart / (F.col("omega") * (1 - F.col("omega")) + 1e-8))
    best = run.groupBy("scene_id").agg(F.max(F.struct("between", -F.col("bin"), "centre")).alias("best"))
    got = best.join(moments, "scene_id")
    eta = px.clip(F.col("best.between") / (F.col("var") + 1e-8), 0, 1)
    return got.select("scene_id", F.col("best.centre").alias("otsu"), eta.alias("eta"), F.greatest(F.col("best.centre"), F.col("mean") + 1.2 * F.col("sd"), F.lit(LEAST_THRESHOLD)).alias("threshold"), F.col("mean").alias("mean_magnitude"))


def change_classes(df: DataFrame) -> DataFrame:
    """Loss, built and water of changed pixels; a class may overlap another."""
    m = F.col("mask")
    loss = m & (F.col("delta_index") < -0.15)
    built = m & (F.col("delta_brightness") > 0.15) & (F.col("delta_index") <= 0.05)
    return df.withColumns({"loss": loss, "built": built, "water": m & (F.col("delta_brightness") < -0.2) & ~loss})


#: A question for both asks for compound change (fixed values).
FROM_GREEN, TO_BUILT = ["vegetation", "green"], ["built", "construct", "develop", "building"]


def asks_for_compound(query: str) -> bool:
    q = query.lower()
    return any(w in q for w in FROM_GREEN) and any(w in q for w in TO_BUILT)


def compound_asked(query: Column) -> Column:
    """R8 for a column of questions."""
    return has(F.lower(query), FROM_GREEN) & has(F.lower(query), TO_BUILT)


def category(compound_query: bool, compound: Column, built: Column, loss: Column) -> Column:
    """P26 (fixed values)."""
    chain = F.when(F.lit(compound_query) & compound, "Vegetation Converted to Built-up Development")
    return chain.when(built > loss, "New Built-up Development").when(loss > 0, "Vegetation Loss / Clearing").otherwise("Land-cover Modification")


def detect(before: DataFrame, after: DataFrame, query: str = "", size: float = PIXEL_SIZE, few: bool | None = None, bounds: Column | None = None, steps: Steps | None = None) -> dict[str, DataFrame | str | None]:
    """The whole of it: ``pixels`` (deltas, mask and classes), ``features``, ``metrics`` (a row for each scene) and the
    limitation. Tables are written on the way, as several results read them; ``steps`` gets their times."""
    steps = steps or Steps()
    with steps.timed("step_temporal_align"):
        few = few_scenes(before) if few is None else few
        joined = deltas(before, after, few, regrid=True)
    delta = steps.written(joined, "deltas", "step_temporal_align", "step_cva", "step_ndvi_delta")
    bar = steps.written(otsu(delta, few=few), "otsu", "step_cva")
    raw = attach(delta, bar.select("scene_id", "threshold"), few).select(*KEY, (F.col("magnitude") > F.col("threshold")).alias("mask"))
    clean = cleaned(raw)
    pixels = steps.written(change_classes(delta.join(clean, KEY)), "changed", "step_ndvi_delta", "step_builtup_gain", "step_change_grounding")
    with steps.timed("step_change_grounding", "step_spatial_intersection"):
        labels = components(pixels)
    extent = extents(before)
    top = top_components(labels, extent, CHANGE)
    per = measured(labels, pixels, {"loss": F.col("loss"), "built": F.col("built")})
    wants = asks_for_compound(query)
    compound = (F.col("built") > 0) & ((F.col("loss") > 0) | F.lit(wants))
    judged = top.join(per, ["scene_id", "label"]).withColumn("compound", compound).withColumn("category", category(wants, F.col("compound"), F.col("built"), F.col("loss")))
    with steps.timed("step_change_grounding", "step_spatial_intersection"):
        filled = fill_density(judged, labels, few).join(bar.select("scene_id", "eta"), "scene_id")
    judged = steps.written(filled, "clusters", "step_change_grounding", "step_spatial_intersection")
    properties = [
        F.col("category"), F.col("quadrant"), F.col("pixels").alias("pixel_count"), F.bround("eta", 3).alias("otsu_separability"),
        F.col("loss").alias("vegetation_loss_pixels"), F.col("built").alias("builtup_gain_pixels"), F.col("compound").alias("is_compound_transition"),
    ]
    found = as_features(shaped(judged), polygons(labels, judged, CHANGE.vertices), F.format_string("change_%d", F.col("rank")), F.col("category"), px.change_confidence(F.col("eta"), F.col("fill")), properties, size, bounds)
    return {"pixels": pixels, "labels": labels, "features": found, "metrics": change_metrics(pixels, judged, bar, extent, size), "limitation": None if nir_of(before) and nir_of(after) else NO_NIR}


#: How the confidence of change came about, around the separability (fixed values).
METHOD = ("Dynamic Otsu separability criterion (η=", ") with morphological cluster coherence")


def change_metrics(pixels: DataFrame, clusters: DataFrame, bar: DataFrame, extent: DataFrame, size: float = PIXEL_SIZE) -> DataFrame:
    """A6."""
    n = F.col("height") * F.col("width")
    counts = pixels.groupBy("scene_id").agg(*[_count(F.col(c)).alias(c) for c in ("mask", "loss", "built", "water")])
    own = clusters.groupBy("scene_id").agg(F.count(F.lit(1)).alias("clusters"), _count(F.col("compound")).alias("transitions"), F.sum(F.when(F.col("compound"), F.col("pixels")).otherwise(0)).alias("converted"))
    got = extent.join(counts, "scene_id").join(bar, "scene_id").join(own, "scene_id", "left").fillna(0, ["clusters", "transitions", "converted"])
    return got.select(
        "scene_id", share(F.col("mask"), n).alias("total_change_pct"), share(F.col("loss"), n).alias("vegetation_loss_pct"), share(F.col("built"), n).alias("builtup_expansion_pct"), share(F.col("water"), n).alias("water_fluctuation_pct"),
        F.col("transitions").alias("compound_transitions_count"), px.hectares(F.col("converted"), size).alias("compound_converted_hectares"), share(F.col("converted"), n).alias("compound_converted_pct"),
        px.hectares(F.col("mask"), size).alias("total_changed_hectares"), F.col("clusters").alias("clusters_count"), F.bround("mean_magnitude", 4).alias("mean_cva_magnitude"), F.bround("threshold", 4).alias("threshold_used"), F.bround("eta", 4).alias("otsu_separability_eta"),
        F.concat(F.lit(METHOD[0]), F.bround("eta", 4).cast("string"), F.lit(METHOD[1])).alias("confidence_method"),
    )
