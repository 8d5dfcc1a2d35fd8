"""N-gram Jaccard join of documents: rare-first prefix filtering, verified once per pair, and its components."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .setjoin import PERCENT, WORDS, buckets, live, passes, suffix_passes, verified
from .shared import saved, sized, table
from .textkernel import SHINGLED_BYTES, SPACES, sequence_keys, shingles, slices, words

#: Cells of the table of shingle counts that orders shingles, whatever the corpus; it decides cost, never results.
CELLS = 1 << 20
#: Cells whose counts of one task are a row together.
BLOCK = 1 << 13
QUARTERS = np.array([1 << 62, 2 << 62, 3 << 62], np.uint64)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def keyed(docs: DataFrame, words_per: int = WORDS) -> DataFrame:
    """doc_id, text key t, number of shingles and two content keys of each text; in rows with a block, a task's counts
    of its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for part, texts in slices(batches, "text", SHINGLED_BYTES):
            w = words(texts, SPACES)
            sets = list(shingles(w, words_per))
            if sets:
                cells += np.bincount((np.concatenate(sets) >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS)
            first, second = sequence_keys(w)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array([len(s) for s in sets], pa.int64()), _long(first), _long(second), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
        used = [k for k in range(CELLS // BLOCK) if cells[k * BLOCK : (k + 1) * BLOCK].any()]
        counts = pa.array([zlib.compress(cells[k * BLOCK : (k + 1) * BLOCK].tobytes(), 1) for k in used], pa.binary())
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(used), pa.int64()) for _ in range(5)), pa.array(used, pa.int32()), counts], names)

    names = ["doc_id", "t", "n", "c", "c2", "block", "counts"]
    return docs.select("doc_id", "text", "t").mapInArrow(run, "doc_id long, t long, n long, c long, c2 long, block int, counts binary")


def cell_counts(rows: DataFrame) -> np.ndarray:
    """The sum of the tasks' counts, CELLS numbers. The counts of a block are added in two rounds, so that no group
    holds more than about the root of the number of tasks."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for c in part["counts"]:
            total += np.frombuffer(zlib.decompress(c), np.int64)
        return pd.DataFrame({"block": part["block"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    told = rows.filter("block is not null").select("block", "counts")
    most = told.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    share = F.pmod(F.xxhash64("counts"), F.lit(math.isqrt(most) + 1)).alias("share")
    told = told.groupBy("block", share).applyInPandas(add, "block int, counts binary")
    out = np.zeros(CELLS, np.int64)
    for r in told.groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, words_per: int, percent: int) -> Iterator[tuple]:
    """Key, sorted set and rare-first prefix of each content, once per task, in lists by slice."""
    seen: set[int] = set()
    for _, texts in slices(batches, "text", SHINGLED_BYTES):
        w = words(texts, SPACES)
        keys, _ = sequence_keys(w)
        found: tuple[list, list, list] = ([], [], [])
        for key, s in zip(keys.tolist(), shingles(w, words_per), strict=True):
            if key in seen or not len(s):
                continue
            seen.add(key)
            length = len(s) + (-len(s) * percent // 100) + 1
            rare = np.lexsort((s, counts[(s >> np.uint64(40)).astype(np.int64) % CELLS]))[:length]
            for column, x in zip(found, (key, s, s[rare]), strict=True):
                column.append(x)
        if found[0]:
            yield found


def indexed(docs: DataFrame, counts: np.ndarray, words_per: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Index rows (h, c, n, pos, rest) of all prefixes. ``rest`` holds how many of the shingles behind pos lie in each
    quarter of the hashes, 16 bits each, for the suffix filter."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets, prefixes in _prefixes(batches, sent.value, words_per, percent):
            n, length = (np.array([len(x) for x in column], np.int64) for column in (sets, prefixes))
            rows, first = np.concatenate(prefixes), np.cumsum(length) - length
            cuts = np.array([np.searchsorted(s, QUARTERS) for s in sets])
            whole = np.diff(np.column_stack((np.zeros(len(n), np.int64), cuts, n)), axis=1)
            quarter, rest = (rows >> np.uint64(62)).astype(np.int64), np.zeros(len(rows), np.int64)
            for k in range(4):
                up = np.cumsum(quarter == k)
                used = up - np.repeat(up[first] - (quarter[first] == k), length)
                rest |= np.minimum(np.repeat(whole[:, k], length) - used, 0x7FFF) << (16 * k)
            pos = np.arange(len(rows)) - np.repeat(first, length)
            yield pa.RecordBatch.from_arrays([_long(rows), _long(np.repeat(np.array(keys, np.uint64), length)), pa.array(np.repeat(n, length).astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(rest)], ["h", "c", "n", "pos", "rest"])

    return docs.select("text").mapInArrow(run, "h long, c long, n int, pos int, rest long")


def shared_index(docs: DataFrame, counts: np.ndarray, words_per: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The index rows whose shingle is in the prefixes of two contents or more. Only shingle and content are shuffled to
    find those shingles; the whole rows, read again, then meet them, at every size by the same kind of join."""
    rows = indexed(docs, counts, words_per, percent)
    shared = rows.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("h")
    return rows.join(saved(shared, "shared").hint("merge"), "h", "left_semi")


def sets_of(docs: DataFrame, words_per: int = WORDS) -> DataFrame:
    """c, c2 and the shingles (items) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, "text", SHINGLED_BYTES):
            w = words(texts, SPACES)
            first, second = sequence_keys(w)
            sets = list(shingles(w, words_per))
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(ends), _long(np.concatenate(sets) if sets else np.zeros(0, np.uint64)))
            yield pa.RecordBatch.from_arrays([_long(first), _long(second), items], ["c", "c2", "items"])

    return docs.select("text").mapInArrow(run, "c long, c2 long, items array<bigint>")


def _may(x: str, y: str, percent: int) -> Column:
    """Length, positional and suffix filters for index rows of one shingle."""
    n, i, m, j = (F.col(f"{side}{name}") for side in (x, y) for name in ("n", "pos"))
    return passes(n, i, m, j, percent) & suffix_passes(n, i, F.col(f"{x}rest"), m, j, F.col(f"{y}rest"), percent)


#: Stands for a null key in joins.
NO_KEY = -(1 << 63)


def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"))


def classes(docs: DataFrame, key: str, text: str, words_per: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, t (key of the text), n and component_id; see jaccard_components.

    Every text is shingled three times: to count, to find shared shingles, and to index those. Sets in a shingle's
    bucket first meet its hub only; then those of different components so far meet each other, so a large group of
    copies costs about its size. Pairs in one component need no test, so no link between components is lost. Contents
    are told apart by two 64-bit keys; buckets, in which a clash would have to happen between two, know only the first.
    Minima by shingle or root are saved before rows are joined to them: so such a join may be split where a key is hot.
    """
    rows = _read(docs, key, text)
    first = saved(keyed(rows, words_per), "keys")
    counts = cell_counts(first)
    own = first.filter("block is null")
    index = saved(shared_index(rows, counts, words_per, percent), "index")
    shared = saved(buckets(index), "buckets")
    entries = saved(live(index, shared, percent).dropDuplicates(["h", "c"]), "entries")

    hubs = entries.filter("c <> hub").filter(_may("", "hub_", percent))
    pairs = saved(hubs.select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct(), "pairs")
    # A row that holds each content: its key, none the least of all, and its text.
    holder = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_KEY)).alias("k"), "t")).alias("holder")
    heads = saved(own.filter("n > 0").groupBy("c", "c2").agg(holder), "heads")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Verify pairs on the sets of their ends, read again from one document of each content."""
        ends = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
        wanted = saved(heads.join(ends, "c", "left_semi").select("holder.*"), "wanted")
        read = rows.withColumn("k", F.coalesce("doc_id", F.lit(NO_KEY))).join(sized(wanted), ["k", "t"], "left_semi")
        return saved(verified(pairs, sets_of(read, words_per), percent).distinct(), name)

    def of(side: str) -> Column:
        """A content or a component as one number, by which buckets tell them apart."""
        return F.xxhash64(f"{side}.c", f"{side}.c2")

    links = linked(pairs, "links")
    roots = saved(components(links), "roots")

    # Buckets that hold several components: the members outside its most common one meet all the others.
    known = roots.select(F.col("node.c").alias("c"), of("root").alias("r"))
    marked = saved(entries.join(known, "c", "left").select("h", "c", "n", "pos", "rest", F.coalesce("r", F.xxhash64("c")).alias("root")), "roles")
    mixed = saved(marked.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("h"), "mixed")
    marked = saved(marked.join(mixed, "h", "left_semi"), "marked")
    main = saved(marked.groupBy("h", "root").count().groupBy("h").agg(F.max(F.struct("count", "root"))["root"].alias("main")), "main")
    marked = marked.join(main, "h")
    x, y = marked.filter("root <> main").alias("x"), marked.alias("y")
    meet = (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.c") < F.col("y.c")))
    rest = x.join(y, meet & _may("x.", "y.", percent))
    rest = rest.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = linked(saved(rest, "rest"), "more")
    roots = saved(components(links.union(more)), "roots")

    # Back from contents to documents: the least key of each component, by content, then each document's own.
    node = roots.select(F.col("node.c").alias("c"), F.col("node.c2").alias("c2"), "root")
    placed = own.filter("n > 0").groupBy("c", "c2").agg(F.min("doc_id").alias("least")).join(node, ["c", "c2"], "left")
    placed = saved(placed.select("c", "c2", "least", "root"), "placed")
    least = saved(placed.filter("root is not null").groupBy("root").agg(F.min("least").alias("of_all")), "least")
    placed = placed.join(least, "root", "left").select("c", "c2", F.coalesce("of_all", "least").alias("component_id"))
    out = own.join(saved(placed, "contents"), ["c", "c2"], "left")
    return out.select("doc_id", "t", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words_per: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: key, n_shingles and component_id, the least key reachable by links, itself included.

    Keys are integers. Each row is a document: rows of one key are linked only if their texts are, and each tells the
    least key reachable from it. Rows without key link like others, and are in the component of the least key that
    others have, null if none has one. Null and wordless texts have no shingles and no links; equal texts are one
    set, met once; extra columns are not read; no rows give no rows.
    """
    out = classes(docs, key, text, words_per, percent)
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` but those that have an earlier one (by key) in their component.

    Of rows that share key and text one stays, whichever; rows without key go if their component has a key; of those
    in components without any key, one of each text stays. Wordless and null texts are in no component with others.
    """
    told = saved(classes(docs, key, text, **how), "classes")
    k = F.coalesce("doc_id", F.lit(NO_KEY)).alias("k")
    gone = saved(told.filter("component_id < doc_id or doc_id is null and component_id is not null").select(k, "t").distinct(), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"))
    rows = rows.join(sized(gone), ["k", "t"], "left_anti")
    again = saved(told.filter("n > 0").groupBy(k, "t").count().filter("count > 1").select("k", "t"), "again")
    if again.limit(1).count():
        twice = rows.join(sized(again), ["k", "t"], "left_semi").dropDuplicates(["k", "t"])
        rows = rows.join(sized(again), ["k", "t"], "left_anti").unionByName(twice)
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
