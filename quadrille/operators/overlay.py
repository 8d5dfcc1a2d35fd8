"""Which shapes of two tables of features overlap (J8): boxes are dealt to the cells of a grid, met there once, and the
pairs whose boxes meet are decided by their polygons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells along a side of the scene; a shape lies in as many as its box touches.
CELLS = 64
BOX = ["ymin", "xmin", "ymax", "xmax"]


def _cell(at: Column, cells: int) -> Column:
    return F.least(F.greatest(F.floor(at * cells), F.lit(0)), F.lit(cells - 1))


def _dealt(shapes: DataFrame, tag: str, cells: int) -> DataFrame:
    row = shapes.select("scene_id", F.struct(*[c for c in shapes.columns if c != "scene_id"]).alias(tag))
    span = lambda low, high: F.sequence(_cell(F.col(f"{tag}.{low}"), cells), _cell(F.col(f"{tag}.{high}"), cells))
    whole = row.filter(F.col(f"{tag}.ymin").isNotNull() & F.col(f"{tag}.xmin").isNotNull() & (F.col(f"{tag}.ymax") >= F.col(f"{tag}.ymin")) & (F.col(f"{tag}.xmax") >= F.col(f"{tag}.xmin")))
    return whole.withColumn("cy", F.explode(span("ymin", "ymax"))).withColumn("cx", F.explode(span("xmin", "xmax")))


def meeting_boxes(a: DataFrame, b: DataFrame, cells: int = CELLS) -> DataFrame:
    """Rows (scene_id, a, b) of the shapes of a scene whose boxes (closed, in shares of the scene) have a point in
    common, each pair once: it is taken in the cell that holds the first corner of what the boxes share, which both of
    them touch. So a scene is spread over its cells, and no pair need be told from its repetitions."""
    both = _dealt(a, "a", cells).join(_dealt(b, "b", cells), ["scene_id", "cy", "cx"])
    first = {k: F.greatest(f"a.{k}", f"b.{k}") for k in ("ymin", "xmin")}
    met = (first["ymin"] <= F.least("a.ymax", "b.ymax")) & (first["xmin"] <= F.least("a.xmax", "b.xmax"))
    here = (_cell(first["ymin"], cells) == F.col("cy")) & (_cell(first["xmin"], cells) == F.col("cx"))
    return both.filter(met & here).select("scene_id", "a", "b")


def ring(polygon: object, box: tuple[float, float, float, float]) -> np.ndarray:
    """The corners (x, y) of a shape: of its polygon if that has three, else of its box."""
    if polygon is not None and len(polygon) >= 3:
        return np.array([(p["x"], p["y"]) for p in polygon], float)
    y0, x0, y1, x1 = box
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)


def _holds(p: np.ndarray, at: np.ndarray) -> bool:
    """Whether a point lies inside a ring, by the edges that a ray from it crosses."""
    q = np.roll(p, -1, axis=0)
    spans = (p[:, 1] > at[1]) != (q[:, 1] > at[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = p[:, 0] + (at[1] - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0])
    return bool(np.count_nonzero(spans & (at[0] < x)) % 2)


def overlap(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two closed polygons have a point in common: an edge of one meets an edge of the other, or one lies in the
    other."""
    a, b = p[:, None, :], np.roll(p, -1, axis=0)[:, None, :]
    c, d = q[None, :, :], np.roll(q, -1, axis=0)[None, :, :]
    side = lambda o, s, t: (s[..., 0] - o[..., 0]) * (t[..., 1] - o[..., 1]) - (s[..., 1] - o[..., 1]) * (t[..., 0] - o[..., 0])
    between = lambda o, s, t: (np.minimum(o, s) <= t).all(-1) & (t <= np.maximum(o, s)).all(-1)
    s1, s2, s3, s4 = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    crossed = (np.sign(s1) * np.sign(s2) < 0) & (np.sign(s3) * np.sign(s4) < 0)
    touched = (s1 == 0) & between(a, b, c) | (s2 == 0) & between(a, b, d) | (s3 == 0) & between(c, d, a) | (s4 == 0) & between(c, d, b)
    return bool((crossed | touched).any()) or _holds(q, p[0]) or _holds(p, q[0])


def overlapping(a: DataFrame, b: DataFrame, cells: int = CELLS) -> DataFrame:
    """meeting_boxes() whose polygons (arrays of x, y) overlap as well; a shape without one is its box. Two boxes that
    meet overlap, so where neither table has polygons, the join is all, and no pair goes through Python."""
    pairs = meeting_boxes(a, b, cells)
    if "polygon" not in a.columns and "polygon" not in b.columns:
        return pairs

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[[not (shaped(p) or shaped(q)) or overlap(ring_of(p), ring_of(q)) for p, q in zip(part["a"], part["b"], strict=True)]]

    shaped = lambda s: s.get("polygon") is not None and len(s["polygon"]) >= 3
    ring_of = lambda s: ring(s.get("polygon"), tuple(s[k] for k in BOX))

    return pairs.mapInPandas(run, pairs.schema)
