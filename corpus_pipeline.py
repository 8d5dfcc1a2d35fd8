"""A corpus pipeline in five stages, each of which reads what the one before has written as Parquet.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.decontamination import decontaminated
from quadrille.llm.jaccard import one_of_each
from quadrille.llm.language import fit, identify
from quadrille.llm.linededup import line_dedup
from quadrille.llm.packing import pack
from quadrille.llm.shared import scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay; lang becomes the predicted one where it was null. Texts without a
    letter, and those unlike every language, go. The model is learned from the labelled documents."""
    model = fit(docs.select("text", "lang"))
    told = identify(docs, model, lang="_lang_pred", score="_lang_score", rejected="_lang_rejected").filter(~F.col("_lang_rejected"))
    return told.select(*[F.coalesce("lang", "_lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def lines_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go; documents stay, and n_chars follows the text."""
    made = line_dedup(docs)
    return made.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that of the least doc_id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to some edits, go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the sequences."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines_deduped),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained centroids and LSH have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{scratch(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
