"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold, fresh, saved, table
from .textkernel import SHINGLED_BYTES, U, mix, slices

#: Hash buckets of character bigrams and trigrams together.
DIMS = 4096
#: Labelled texts per language that the centroids are fitted on, about; the rest only counts for IDF.
SAMPLE_PER_LANGUAGE = 400
#: More languages raise an error; the model then takes 260 MB. Samples come to the driver by so many languages at once.
MOST_LANGUAGES = 4000
LANGUAGES_AT_ONCE = 16
CENTROIDS = 4
#: Texts whose counts, DIMS numbers each, are held at once.
ROWS_AT_ONCE = 256
#: A text is rejected below this share of the similarity that the sample's least typical texts of its size reach.
REJECT_SHARE = 0.5
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (languages * CENTROIDS, DIMS)
    floors: np.ndarray  # least similarity by log2 of the number of n-grams


def counts(texts: pa.Array) -> np.ndarray:
    """n-gram counts, a row of DIMS buckets for each text. Case is folded; runs of non-letters are one blank."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ").to_pylist()
    size = np.fromiter(map(len, plain), np.int64, len(plain)) + 2
    points = np.frombuffer("".join(f" {t} " for t in plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    row = np.repeat(np.arange(len(plain), dtype=np.int64), size)
    out = np.zeros(len(plain) * DIMS, np.float32)
    for n in (2, 3):
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = points[:m] + U(n)
        for j in range(1, n):
            h = h * U(0x100000001B3) + points[j : m + j]
        kept = row[:m] == row[n - 1 :]
        cell = row[:m] * DIMS + (mix(h) >> U(40)).astype(np.int64) % DIMS
        out += np.bincount(cell[kept], minlength=len(out)).astype(np.float32)
    return out.reshape(len(plain), DIMS)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def size_bin(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(c.sum(axis=1) + 1).astype(int), 39)


def clustered(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, started at far apart rows; of fewer rows than ``k``, rows repeat."""
    seeds = [0]
    for _ in range(1, k):
        seeds.append(int((v @ v[seeds].T).max(axis=1).argmin()))
    c = v[seeds]
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        for j in range(k):
            if (near == j).any():
                mean = v[near == j].mean(axis=0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return c


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from rows whose language is not null. Document frequencies count all of them; centroids come from a
    hash sample of about SAMPLE_PER_LANGUAGE distinct texts per language, which reach the driver by LANGUAGES_AT_ONCE."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than MOST_LANGUAGES = {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(40, np.float32))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(DIMS, np.int64), 0
        for part, texts in slices(batches, "text", SHINGLED_BYTES, ROWS_AT_ONCE):
            total += (counts(texts) > 0).sum(axis=0)
            seen += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(np.append(total, seen))], ["bucket", "n"])

    df = rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(DIMS + 1)
    n[df["bucket"]] = df["n"]
    idf = np.log((1 + n[-1]) / (1 + n[:-1])).astype(np.float32) + 1

    # A share of each language's distinct texts, and a hard cap well above its expected yield. Whole texts are counted
    # by the executors; the driver gets a vector of DIMS numbers for each sampled text.
    shares = rows.sparkSession.createDataFrame([(k, min(1.0, SAMPLE_PER_LANGUAGE / max(sizes[k], 1))) for k in languages], "lang string, share double")
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    sample = rows.join(F.broadcast(shares), "lang").filter(drawn).select("text", "lang").dropDuplicates(["lang", "text"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", SHINGLED_BYTES, ROWS_AT_ONCE):
            made = counts(texts)
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("key"), pa.array([r.tobytes() for r in made], pa.binary())], ["lang", "key", "counts"])

    sample = sample.select("lang", F.xxhash64("text").alias("key"), "text").mapInArrow(counted, "lang string, key long, counts binary")
    blocks = [languages[i : i + LANGUAGES_AT_ONCE] for i in range(0, len(languages), LANGUAGES_AT_ONCE)]
    if len(blocks) > 1:
        sample = saved(sample, "languages")

    @lru_cache(maxsize=1)
    def read(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = sample.filter(F.col("lang").isin(blocks[block])) if len(blocks) > 1 else sample
        taken = own.limit(2 * SAMPLE_PER_LANGUAGE * len(blocks[block]) + 1000).toPandas().sort_values(["lang", "key"])
        c = np.frombuffer(b"".join(taken["counts"]), np.float32).reshape(-1, DIMS)
        return taken["lang"].to_numpy(), vectors(c, idf), size_bin(c)

    centroids = np.zeros((len(languages) * CENTROIDS, DIMS), np.float32)
    for i, k in enumerate(languages):
        own, v, _ = read(i // LANGUAGES_AT_ONCE)
        if (own == k).any():
            centroids[i * CENTROIDS : (i + 1) * CENTROIDS] = clustered(v[own == k], CENTROIDS)
    seen = [((v @ centroids.T).max(axis=1), b) for _, v, b in map(read, reversed(range(len(blocks))))]
    near, bins = (np.concatenate(x) for x in zip(*seen, strict=True))
    floors, low = np.zeros(40, np.float32), 0.0
    for b in range(40):
        if (bins == b).sum() >= 5:
            low = REJECT_SHARE * float(np.quantile(near[bins == b], 0.01))
        floors[b] = low
    return Model(languages, idf, centroids, floors)


def predict(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected. Texts without a letter are UNKNOWN, with score 0, and rejected; of
    a model without languages all are UNKNOWN, and no others are rejected, for want of anything to be unlike."""
    c = counts(texts)
    lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    if not model.languages:
        return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), ~lettered
    near = (vectors(c, model.idf) @ model.centroids.T).reshape(len(texts), -1, CENTROIDS).max(axis=2)
    p = np.exp(20 * (near - near.max(axis=1, keepdims=True)).astype(float))
    best = near.argmax(axis=1)
    sure = p.max(axis=1) / p.sum(axis=1)
    rejected = ~lettered | (near.max(axis=1) < model.floors[size_bin(c)])
    return np.where(lettered, np.array(model.languages, object)[best], UNKNOWN), np.where(lettered, sure, 0.0), rejected


def identify(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", rejected: str = "rejected", keep: list[str] | None = None) -> DataFrame:
    """Add language, score and rejection to the rows of ``df``, of which ``keep`` (all) columns stay. No shuffle.

    Null and letterless texts are ``und``; whole texts are read however long; equal texts, and so repeated rows, get
    the same; of equally near languages the first by name is taken; empty tables stay empty. The
    model (DIMS by languages, of which MOST_LANGUAGES are allowed) travels with the tasks.
    """
    names = list(df.columns if keep is None else keep)
    kept = [n for n in names if n not in (lang, score, rejected)]
    hidden = text if text in kept else fresh(names + [lang, score, rejected], "text_read")[0]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)
    model_sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, hidden, SHINGLED_BYTES, ROWS_AT_ONCE):
            found, sure, out = predict(model_sent.value, texts)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.string()), pa.array(sure, pa.float64()), pa.array(out, pa.bool_())], [*kept, lang, score, rejected])

    comma = ", " if schema else ""
    read = df.select(*kept) if hidden in kept else df.select(*kept, F.col(text).alias(hidden))
    return read.mapInArrow(run, f"{schema}{comma}`{lang}` string, `{score}` double, `{rejected}` boolean")


def held_out(key: str = "doc_id") -> Column:
    return fold(key, 4) == 2


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~F.coalesce(held_out(), F.lit(False))).select("text", "lang"))
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return identify(rows, model, keep=["doc_id", "held_out"])
