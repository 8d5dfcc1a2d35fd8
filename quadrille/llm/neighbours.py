"""Approximate nearest neighbours by inner product: an inverted multi-index over the two halves of the vectors.

Each half is quantised by its own centroids; a row belongs to the cell of its pair. A query visits pairs in the order
of their summed distance, by a heap, until its cells hold enough rows, and the rows met are ranked exactly.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import saved, scratch, table

#: Vectors that the centroids are fitted on, about, drawn by hash; every row is indexed.
SAMPLE = 8_000
CENTROIDS = 64
#: Rows that a query's cells hold together: this share of all, and at least so many. Vectors without clusters, as in
#: the given tables, need so large a share for a recall over 0.9; clustered ones need far less.
VISIT_SHARE = 0.45
VISIT_LEAST = 1_000
#: The part of those that is visited first, so that later cells are held against what was found there.
FIRST_PART = 0.1
NEAREST = 20
#: Queries that are sent to the tasks at once, as vectors and two bits for each cell.
QUERY_ROWS = 4_096
#: Rows of a cell that meet its queries at once, bytes of vectors of one task, and queries whose cells one task finds.
ROWS_AT_ONCE = 1_024
TASK_BYTES = 32 << 20
QUERIES_A_TASK = 256


@dataclass
class Index:
    split: int
    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray  # rows by cell, (CENTROIDS, CENTROIDS)


def kmeans(v: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(3))
    c = v[rng.permutation(len(v))[:k]].copy()
    for _ in range(rounds):
        near = nearest(v, c)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = v[near == j].mean(axis=0)
    return c


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (v**2).sum(axis=1, keepdims=True) - 2 * v @ c.T + (c**2).sum(axis=1)


def nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(v, c).argmin(axis=1)


def usable(vec: Column, dims: int | None = None) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, and not zero."""
    number = lambda x: x.cast("double")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < F.lit(float("inf"))))
    some = F.exists(vec, lambda x: x != 0)
    right = F.size(vec) == dims if dims else F.size(vec) > 0
    return F.coalesce(vec.isNotNull() & right & fine & some, F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dims)


def traversed(query: np.ndarray, x: Index, wanted: int) -> list[int]:
    """Cells with rows by summed distance (the less, the greater the inner product) of their halves' centroids, until
    they hold ``wanted`` rows. The heap has, of each first half that was begun, the next pair; taking the first pair of
    one begins the next."""
    d1, d2 = -(x.first @ query[: x.split]), -(x.second @ query[x.split :])
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, sizes = d1[o1].tolist(), d2[o2].tolist(), x.sizes[np.ix_(o1, o2)].tolist()
    heap, out, held = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heap[0]
        if sizes[i][j]:
            out.append((i, j))
            held += sizes[i][j]
        if j + 1 < len(s2):
            heapq.heapreplace(heap, (s1[i] + s2[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    at = np.array(out, np.int64).reshape(-1, 2)
    return (o1[at[:, 0]] * len(x.second) + o2[at[:, 1]]).tolist()


def fit(rows: DataFrame, dims: int, total: int) -> Index:
    """Centroids of both halves, from a hash sample of the rows (id, v) that bounds what the driver gets."""
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1.0, SAMPLE / max(total, 1)) * (1 << 30)).limit(2 * SAMPLE)
    v = np.array(drawn.toPandas().sort_values("id")["v"].tolist(), float).reshape(-1, dims)
    if not len(v):
        v = np.array([r["v"] for r in rows.limit(1).collect()], float).reshape(-1, dims)
    split = dims // 2
    k = min(CENTROIDS, len(v))
    return Index(split, kmeans(v[:, :split], k), kmeans(v[:, split:], k), np.zeros((k, k), np.int64))


def nearest_of(who: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates the ``k`` with the greatest score for each query, the smaller key first among equals."""
    order = np.lexsort((ids, -score, who))
    who, score, ids = who[order], score[order], ids[order]
    best = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[best], score[best], ids[best]


class Ranker:
    """The nearest ``k`` of a block of queries among the rows it is shown, cell by cell. Only queries that visit a cell
    are multiplied with its rows; ``products`` counts how many products that were. ``least`` is what a product must
    reach for each query."""

    def __init__(self, askers: np.ndarray, q: np.ndarray, visiting: np.ndarray, least: np.ndarray, k: int) -> None:
        self.askers, self.q, self.visiting, self.least, self.k = askers, q, visiting, least.copy(), k
        self.found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        self.waiting = self.products = 0

    def meet(self, cell: int, e: np.ndarray, ids: np.ndarray) -> None:
        who = np.flatnonzero(np.unpackbits(self.visiting[cell], count=len(self.askers)))
        if not len(who):
            return
        near = self.q[who] @ e.T
        self.products += near.size
        near[self.askers[who][:, None] == ids] = -np.inf
        bar = self.least[who][:, None]
        if len(ids) > self.k:
            bar = np.maximum(bar, np.partition(near, -self.k, axis=1)[:, [-self.k]])
        # What may be among the nearest is measured once more, one product after the other.
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(bar), bar, 0)))
        i, j = np.nonzero((near >= bar - slack) & (near > -np.inf))
        self.found.append((who[i], (e[j] * self.q[who[i]]).sum(axis=1), ids[j]))
        self.waiting += len(i)
        if self.waiting > 4 * self.k * len(self.askers):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep the nearest of what was found, and raise what is asked of the rest."""
        who, score, ids = nearest_of(*(np.concatenate(x) for x in zip(*self.found, strict=True)), self.k)
        held = np.bincount(who, minlength=len(self.askers))
        full = held == self.k
        self.least[full] = np.maximum(self.least[full], score[np.cumsum(held)[full] - 1])
        self.found, self.waiting = [(who, score, ids)], 0
        return who, score, ids


def search(df: DataFrame, queries: Column, k: int = NEAREST, key: str = "vec_id", vector: str = "embedding", share: float = VISIT_SHARE, least: int = VISIT_LEAST) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the nearest ``k`` found for each row of ``df`` that ``queries`` selects,
    itself excepted; ties to the smaller key; scores are inner products of the original vectors in double precision.

    Vectors that are null, zero, of another size than most, or hold null or non-finite components take no part, nor
    do null keys; of rows with one key, each is a candidate, and the first by vector asks. An empty table gives no
    rows; other columns are not read. Rows are dealt by ranges of cells, in which a cell of many equal vectors is cut.
    Queries go to the tasks in blocks of about QUERY_ROWS, each with the cells it visits, and are multiplied with the
    rows of those alone. A block's nearest cells come first: what they hold bounds what later cells give back, so that
    few rows beside the final ones are written, however many tasks there are.
    """
    spark = df.sparkSession
    named = df.filter(F.col(key).isNotNull() & usable(F.col(vector)))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = named.groupBy(F.size(vector).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return empty
    dims, total = common["dims"], common["count"]
    rows = named.filter(F.size(vector) == dims).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    x = fit(rows, dims, total)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"), dims)
            cell = nearest(v[:, : x.split], x.first) * len(x.second) + nearest(v[:, x.split :], x.second)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], ["id", "v", "asks", "cell"])

    placed = rows.mapInArrow(place, "id long, v array<double>, asks boolean, cell int")
    tasks = max(spark.sparkContext.defaultParallelism, -(-total * dims * 8 // TASK_BYTES))
    placed = saved(placed.repartitionByRange(tasks, "cell", F.xxhash64("id")).sortWithinPartitions("cell"), "placed")
    for r in placed.groupBy("cell").count().collect():  # CENTROIDS squared rows at most
        x.sizes.flat[r["cell"]] = r["count"]
    wanted = int(min(total, max(least, share * total)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = x.sizes.ravel()
        for b in batches:
            bits = np.zeros((2, b.num_rows, x.sizes.size), bool)
            for i, q in enumerate(matrix(b.column("v"), dims)):
                cells = np.array(traversed(q, x, wanted), np.int64)
                first = int(np.searchsorted(np.cumsum(sizes[cells]), FIRST_PART * wanted)) + 1
                bits[0, i, cells[:first]], bits[1, i, cells[first:]] = True, True
            packed = [pa.array([r.tobytes() for r in np.packbits(part, axis=1)], pa.binary()) for part in bits]
            yield pa.RecordBatch.from_arrays([*b.columns, *packed], ["block", "id", "v", "cells0", "cells1"])

    asking = placed.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    n_queries = asking.count()
    if not n_queries:
        return empty
    blocks = -(-n_queries // QUERY_ROWS)
    asking = asking.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    asking = asking.repartition(-(-n_queries // QUERIES_A_TASK), "id")
    at = f"{scratch(spark)}/quadrille/{uuid.uuid4().hex}"
    visits = asking.mapInArrow(visit, "block int, id long, v array<double>, cells0 binary, cells1 binary")
    # A folder for each block, so that no other is read with it.
    visits.write.partitionBy("block").parquet(f"{at}/visits")
    schema = "query_id long, vec_id long, score double"
    nearest_first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for block in range(blocks):
        own = spark.read.parquet(f"{at}/visits").filter(F.col("block") == block).drop("block").toPandas().sort_values("id")
        if not len(own):
            continue
        askers, q, bars = own["id"].to_numpy(np.int64), np.stack(own["v"].to_list()), np.full(len(own), -np.inf)
        for part in (0, 1):
            cells = np.unpackbits(np.stack([np.frombuffer(c, np.uint8) for c in own[f"cells{part}"]]), axis=1)[:, : x.sizes.size]
            sent = spark.sparkContext.broadcast((askers, q, np.packbits(cells.T, axis=1), bars))

            def rank(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                ranker = Ranker(*sent.value, k)
                for b in batches:
                    e, ids, cell = matrix(b.column("v"), dims), b.column("id").to_numpy(), b.column("cell").to_numpy()
                    cuts = np.flatnonzero(np.diff(cell)) + 1
                    for low, high in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                        for i in range(low, high, ROWS_AT_ONCE):
                            j = min(high, i + ROWS_AT_ONCE)
                            ranker.meet(cell[i], e[i:j], ids[i:j])
                who, score, ids = ranker.settle()
                yield pa.RecordBatch.from_arrays([pa.array(ranker.askers[who]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

            found = f"{at}/found/block={block}/part={part}"
            placed.select("cell", "id", "v").mapInArrow(rank, schema).write.parquet(found)
            sent.unpersist()
            if part == 0:
                held = spark.read.schema(schema).parquet(found).withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") == k).select("query_id", "score").toPandas()
                bars[np.searchsorted(askers, held["query_id"].to_numpy(np.int64))] = held["score"]
    ranked = spark.read.schema(f"{schema}, block int, part int").parquet(f"{at}/found").withColumn("rank", F.row_number().over(nearest_first))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
