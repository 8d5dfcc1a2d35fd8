"""Connected components of masks (N5): labels inside tiles, then across the seams.

Tiles are labelled by numpy. Only pixels at seams, about 4 in TILE, meet their neighbours in a join; the labels that
touch are then brought together by rounds of joins on the labels, never on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import KEY
from .neighbours import TILE, by_tile
from .storage import written

MOST_ROUNDS = 60
#: Labels that are numbered in one task, at most.
RANGE = 1 << 16


def label_tile(mask: np.ndarray) -> np.ndarray:
    """For each set place the least place, in rows, of its 4-connected component; -1 elsewhere. Roots are hooked to
    lesser ones and paths halved until no two neighbours differ."""
    places = np.flatnonzero(mask)
    number = np.full(mask.size, -1, np.int64)
    number[places] = np.arange(len(places))
    number = number.reshape(mask.shape)
    across, down = mask[:, :-1] & mask[:, 1:], mask[:-1] & mask[1:]
    a = np.concatenate((number[:, :-1][across], number[:-1][down]))
    b = np.concatenate((number[:, 1:][across], number[1:][down]))
    root = np.arange(len(places))
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    out = np.full(mask.size, -1, np.int64)
    out[places] = places[root]
    return out.reshape(mask.shape)


def merged(edges: DataFrame) -> DataFrame:
    """Rows (scene_id, label, root) for all labels in ``edges`` (scene_id, a, b): the least label each can reach.

    Large and small stars alternate, each a join and an aggregate whose minima combine before the shuffle; a table is
    written after each round, and the rounds end when one changes nothing. Rounds grow with the logarithm of a chain.
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        one = e.select("scene_id", F.col("a").alias("u"), F.col("b").alias("v"))
        both = one.union(e.select("scene_id", F.col("b").alias("u"), F.col("a").alias("v"))) if large else one
        least = both.groupBy("scene_id", "u").agg(F.min("v").alias("m")).select("scene_id", "u", F.least("u", "m").alias("m"))
        rows = both.join(least, ["scene_id", "u"])
        made = rows.filter("v > u") if large else rows
        made = made.select("scene_id", F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            made = made.union(least.select("scene_id", F.col("u").alias("a"), F.col("m").alias("b")))
        return made.filter("a <> b").distinct()

    e = edges.filter("a <> b").select("scene_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = written(e, "seams"), None
    for _ in range(MOST_ROUNDS):
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("scene_id", "a", "b"))).first()
        if now == before or now[0] == 0:
            return e.select("scene_id", F.col("a").alias("label"), F.col("b").alias("root"))
        before, e = now, written(stars(stars(e, True), False), "seams")
    raise RuntimeError(f"labels did not come together in {MOST_ROUNDS} rounds")


def components(df: DataFrame, mask: str = "mask", tile: int = TILE, stride: int | None = None) -> DataFrame:
    """scene_id, y, x and label of each set pixel: the least ``y * stride + x`` of its 4-connected component, so labels
    are in the order in which rows meet the components. ``df`` has every pixel, or the set ones only; y, x >= 0.

    ``stride`` is over every x (32 bits of x by default).
    """
    stride = stride or 1 << 32
    rows = df.filter(F.col(mask))

    def kernel(arrays: dict, there: np.ndarray, info: dict) -> dict:
        m = arrays[mask] & there
        at = label_tile(m)
        side = m.shape[1]
        return {"label": (at // side + info["y0"]) * stride + at % side + info["x0"], "keep": m}

    local = written(by_tile(rows.select(*KEY, mask), [mask], 0, kernel, "label long", tile), "labels")
    seam = local.filter((F.pmod("y", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("x", F.lit(tile)).isin(0, tile - 1)))
    moved = [
        seam.filter(F.pmod("y", F.lit(tile)) == tile - 1).select("scene_id", (F.col("y") + 1).alias("y"), "x", F.col("label").alias("a")),
        seam.filter(F.pmod("x", F.lit(tile)) == tile - 1).select("scene_id", "y", (F.col("x") + 1).alias("x"), F.col("label").alias("a")),
    ]
    met = moved[0].union(moved[1]).join(seam.withColumnRenamed("label", "b"), KEY).select("scene_id", "a", "b")
    roots = merged(met)
    return local.join(roots, ["scene_id", "label"], "left").select(*KEY, F.coalesce("root", "label").alias("label"))


def sizes(labels: DataFrame) -> DataFrame:
    """Pixels and tight bounds, ends exclusive, of each component."""
    return labels.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("pixels"), F.min("y").alias("ymin"), (F.max("y") + 1).alias("ymax"), F.min("x").alias("xmin"), (F.max("x") + 1).alias("xmax"))


def numbered(sized: DataFrame) -> DataFrame:
    """Components of a scene numbered from 1 in the order in which rows meet them. Labels are cut into ranges, and
    numbers inside a range go up by the sizes of those before, so no task sorts a whole scene."""
    sized = written(sized, "sized").withColumn("range", F.floor(F.col("label") / RANGE))
    before = W.partitionBy("scene_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = sized.groupBy("scene_id", "range").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(W.partitionBy("scene_id", "range").orderBy("label"))
    made = sized.withColumn("number", inside).join(written(counts, "ranges"), ["scene_id", "range"])
    return made.withColumn("number", (F.col("number") + F.col("base")).cast("int")).drop("range", "base")


def largest(sized: DataFrame, extent: DataFrame, keep: int, share: float, least: int) -> DataFrame:
    """The ``keep`` largest, less those under max(int(share of the scene), least) pixels; ties go to the earlier
    label. ``rank`` counts from 1, and height and width of the scene are added."""
    order = W.partitionBy("scene_id").orderBy(F.desc("pixels"), "label")
    ranked = sized.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    bar = F.greatest(F.floor(F.col("height") * F.col("width") * share), F.lit(least))
    return ranked.join(extent, "scene_id").filter(F.col("pixels") >= bar)
