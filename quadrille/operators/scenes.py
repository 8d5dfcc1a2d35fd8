"""Values of whole scenes and their way back to the pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written

#: Scenes up to which a table of one row each may be broadcast (about 100 bytes a row).
BROADCAST_SCENES = 100_000
#: Accuracy of the sketches that bound a quantile, and by what share of all ranks they are set apart from it.
ACCURACY = 10_000
SLACK = 2.5e-4
#: Distinct values that one task may order, and parts into which more are cut.
TASK_VALUES = 500_000
PARTS = 32


def few_scenes(pixels: DataFrame, limit: int = BROADCAST_SCENES) -> bool:
    """Whether a count proves that there are at most ``limit`` scenes; it reads one column."""
    return pixels.select("scene_id").distinct().limit(limit + 1).count() <= limit


def attach(pixels: DataFrame, stats: DataFrame, few: bool | None = None) -> DataFrame:
    """The columns of ``stats``, a row for each scene, beside those of the pixels. Broadcast if the scenes are
    few, which is counted unless the caller knows; else both sides shuffle."""
    few = few_scenes(pixels) if few is None else few
    return pixels.join(F.broadcast(stats) if few else stats, "scene_id")


def extents(pixels: DataFrame) -> DataFrame:
    """scene_id, y0, x0, height and width of each scene, from the places of its pixels."""
    return pixels.groupBy("scene_id").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") - F.min("y") + 1).alias("height"), (F.max("x") - F.min("x") + 1).alias("width"))


# --- counts of values --------------------------------------------------------------------------------------------


def value_counts(pixels: DataFrame, values: dict[str, str]) -> DataFrame:
    """The value histogram: rows (scene_id, name, v, n) of how often each value of each ``name: column`` occurs.
    Missing values and NaN are left out. Equal values combine before the shuffle, so for whole-number bands what is
    shuffled is bounded by the distinct values and tasks, not by the pixels."""
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("v")) for n, c in values.items()])
    rows = pixels.select("scene_id", F.inline(listed)).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return rows.groupBy("scene_id", "name", "v").agg(F.count(F.lit(1)).alias("n"))


def _narrowed(held: DataFrame, on: list[str]) -> DataFrame:
    """``held`` (see picked()) without the values of the PARTS parts of equally many values each that hold no wanted
    rank. The parts are cut by ranks, not by values, so an outlier changes nothing."""
    cuts = held.groupBy(*on).agg(F.percentile_approx("v", F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)]), F.lit(ACCURACY)).alias("cuts"))
    dealt = held.join(cuts, on).withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("v")))).drop("cuts")
    before = W.partitionBy(*on).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy(*on, "part", "at").agg(F.sum("n").alias("in_part"), F.max("below").alias("below"))
    sums = sums.withColumn("below", F.col("below") + F.coalesce(F.sum("in_part").over(before), F.lit(0)))
    wanted = sums.filter((F.floor("at") < F.col("below") + F.col("in_part")) & (F.ceil("at") >= F.col("below")))
    # Of two parts between which the wanted rank lies both stay, and what is below the first is below both.
    wanted = wanted.select(*on, "part", F.min("below").over(W.partitionBy(*on)).alias("below"))
    return dealt.drop("below").join(wanted, [*on, "part"]).drop("part")


def picked(held: DataFrame, on: list[str], most: int = TASK_VALUES) -> DataFrame:
    """The value ``q`` at rank ``at`` (from 0, linear between neighbours) of each group ``on``, of written rows
    (*on, at, below, v, n): distinct values with their counts, and how many values lie below all of them.

    A group is ordered in one task only when it has at most ``most`` values; until then its parts without the wanted
    rank are dropped, which leaves about two PARTS-ths a round.
    """
    while held.groupBy(*on).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] > most:
        held = written(_narrowed(held, on), "held")
    upto = W.partitionBy(*on).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    placed = held.withColumn("upto", F.col("below") + F.sum("n").over(upto))
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    ends = placed.groupBy(*on).agg(first(F.floor("at")).alias("a"), first(F.ceil("at")).alias("b"), F.max("at").alias("at"))
    return ends.select(*on, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("q"))


def _across(found: DataFrame, names: list[str], shares: list[float]) -> DataFrame:
    return found.groupBy("scene_id").agg(*[F.max(F.when((F.col("name") == n) & (F.col("i") == i), F.col("q"))).alias(f"{n}_q{i}") for n in names for i in range(len(shares))])


def _percentiles(names: list[str], shares: list[float]) -> list[Column]:
    return [F.percentile(F.when(F.col("name") == n, F.col("v")), F.lit(s), F.col("n")).alias(f"{n}_q{i}") for n in names for i, s in enumerate(shares)]


def quantiles_of(counts: DataFrame, names: list[str], shares: list[float], most: int = TASK_VALUES) -> DataFrame:
    """The quantiles of a written value histogram: a row for each scene with ``<name>_q0``, ``_q1``, ... If a count shows
    that all of it has at most ``most`` rows, as of bands of 8 bits, the built-in percentile takes it in one pass."""
    if counts.count() <= most:
        return counts.groupBy("scene_id").agg(*_percentiles(names, shares))
    total = counts.groupBy("scene_id", "name").agg(F.sum("n").alias("total"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("total") - 1)).alias("at")) for i, s in enumerate(shares)])
    ranks = total.select("scene_id", "name", F.inline(wanted))
    held = counts.filter(F.col("name").isin(names)).join(ranks, ["scene_id", "name"]).withColumn("below", F.lit(0).cast("long"))
    return _across(picked(held, ["scene_id", "name", "i"], most), names, shares)


def is_whole(pixels: DataFrame, column: str) -> bool:
    return pixels.schema[column].dataType.typeName() in ("byte", "short", "integer")


def quantiles(pixels: DataFrame, values: dict[str, str], shares: list[float], few: bool | None = None, also: list[Column] | None = None, most: int = TASK_VALUES) -> DataFrame:
    """Exact quantiles, linear between neighbours in order: a row for each scene with ``<name>_q0``, ``_q1``, ... for
    the ``shares`` of each ``name: column``, and the aggregates ``also`` of all its pixels.

    Whole-number columns are read once, into their value histogram. Of others a first reading bounds each quantile by
    two approximate ones, some SLACK of all ranks apart whatever the values are; a second counts what is below and
    takes what is between. Only that is ordered, equal values being one, and by further rounds if it is much (picked()).
    """
    few = few_scenes(pixels) if few is None else few
    whole = [n for n, c in values.items() if is_whole(pixels, c)]
    floats = {n: values[n] for n in values if n not in whole}
    out = None
    if whole:
        out = quantiles_of(written(value_counts(pixels, {n: values[n] for n in whole}), "counts"), whole, shares, most)
    if floats:
        made = _float_quantiles(pixels, floats, shares, few, also or [], most)
        return made if out is None else out.join(made, "scene_id", "full")
    return out.join(pixels.groupBy("scene_id").agg(*also), "scene_id", "right") if also else out


def _float_quantiles(pixels: DataFrame, values: dict[str, str], shares: list[float], few: bool, also: list[Column], most: int) -> DataFrame:
    number = {n: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for n, c in values.items()}
    near = lambda d: F.broadcast(d) if few else d
    slack = SLACK
    while True:
        sides = F.array(*[F.lit(min(max(s + d, 0.0), 1.0)) for s in shares for d in (-slack, slack)])
        first = [a for n, v in number.items() for a in (F.percentile_approx(v, sides, F.lit(ACCURACY)).alias(f"{n}_sides"), F.count(v).alias(f"{n}_total"))]
        scene = written(pixels.groupBy("scene_id").agg(*first, *also), "sides")
        wanted = [
            F.struct(F.lit(n).alias("name"), F.lit(i).alias("i"), (F.lit(float(s)) * (F.col(f"{n}_total") - 1)).alias("at"), v.alias("v"), *[(F.get(f"{n}_sides", F.lit(2 * i + k)) if slack < 1 else F.lit(float("-inf" if k == 0 else "inf"))).alias(e) for k, e in enumerate(("low", "high"))])
            for n, v in number.items() for i, s in enumerate(shares)
        ]
        rows = attach(pixels.select("scene_id", *{c for c in values.values()}), near(scene.drop(*[c for c in scene.columns if not c.endswith(("_sides", "_total")) and c != "scene_id"])), few)
        rows = rows.select("scene_id", F.inline(F.array(*wanted))).filter(F.col("v") <= F.col("high"))
        kept = rows.groupBy("scene_id", "name", "i", "at", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        kept = written(kept, "between")
        on = ["scene_id", "name", "i"]
        below = kept.groupBy(*on, "at").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("below"), F.sum("n").alias("upto"))
        if slack >= 1 or not below.filter((F.col("below") > F.floor("at")) | (F.col("upto") <= F.ceil("at"))).limit(1).count():
            break
        slack *= 50  # a sketch was further off than it promises
    held = written(kept.filter("v is not null").join(below.select(*on, "below"), on), "held")
    found = _across(picked(held, on, most), list(values), shares)
    return scene.drop(*[f"{n}_{x}" for n in values for x in ("sides", "total")]).join(found, "scene_id", "left")


def band_statistics(pixels: DataFrame, bands: list[str], shares: list[float], few: bool | None = None) -> tuple[DataFrame, DataFrame | None]:
    """A row for each scene with ``low_<band>``, ``high_<band>`` and the quantiles ``<band>_q0``, ... of all bands, and
    the written value histogram from which all of it is taken, if all bands are whole numbers."""
    ends = lambda b, own: [F.min(own).alias(f"low_{b}"), F.max(own).alias(f"high_{b}")]
    if not all(is_whole(pixels, b) for b in bands):
        return quantiles(pixels, {b: b for b in bands}, shares, few, [x for b in bands for x in ends(b, b)]), None
    counts = written(value_counts(pixels, {b: b for b in bands}), "counts")
    extremes = [x for b in bands for x in ends(b, F.when(F.col("name") == b, F.col("v")))]
    if counts.count() <= TASK_VALUES:
        return counts.groupBy("scene_id").agg(*extremes, *_percentiles(bands, shares)), counts
    found = counts.groupBy("scene_id").agg(*extremes)
    return written(found.join(quantiles_of(counts, bands, shares), "scene_id"), "bands"), counts


def share(count: Column, of: Column, digits: int = 2) -> Column:
    """A percentage; 0 of nothing."""
    return F.bround(F.coalesce(count / F.nullif(of, F.lit(0)), F.lit(0.0)) * 100, digits)
