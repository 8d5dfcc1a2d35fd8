"""Results as an append-only table that all sessions share."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .schema import RESULT

MOST = 20


def save(results: DataFrame, path: str, run: str | None = None, day: str | None = None, expected: int = 1_000_000) -> None:
    """Add results, kept by the day and the run that made them. A run that is saved again under its name and day takes
    the place of what it saved before, so a job that is tried once more adds nothing twice. Files have a Bloom filter of
    ``expected`` analysis ids, which are random, so that extremes of a row group tell nothing."""
    run, day = run or uuid.uuid4().hex, day or time.strftime("%Y-%m-%d", time.gmtime())
    rows = results.select(*RESULT.fieldNames(), F.lit(day).alias("day"), F.lit(run).alias("run"))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run")
    writer.option("parquet.bloom.filter.enabled#analysis_id", "true").option("parquet.bloom.filter.expected.ndv#analysis_id", str(expected)).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """All results, with the day and the run that they were saved under."""
    return spark.read.schema(StructType([*RESULT.fields, StructField("day", StringType()), StructField("run", StringType())])).parquet(path)


def bootstrap(spark: SparkSession, path: str) -> DataFrame:
    """Results kept as JSON documents, a file each; documents that cannot be read are left out."""
    schema = StructType([*RESULT.fields, StructField("_broken", StringType())])
    rows = spark.read.schema(schema).option("multiLine", "true").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.filter("_broken is null").drop("_broken")


def lookup(results: DataFrame, analysis_id: str, day: str | None = None) -> DataFrame:
    """The filter reaches the Parquet scan, which passes over row groups whose Bloom filter has not the id; with
    ``day`` other days' folders are not opened at all."""
    found = results.filter(F.col("analysis_id") == analysis_id)
    return found.filter(F.col("day") == day) if day else found


def recent(results: DataFrame, by: str = "execution_time_ms", most: int = MOST, id: str = "analysis_id") -> DataFrame:
    """The first ``most`` by run time, longest first, or by another column such as created_at; missing counts as
    least, ties go by id."""
    return results.orderBy(F.col(by).desc_nulls_last(), id).limit(most)


def dossier(results: DataFrame) -> DataFrame:
    """One JSON document for each result."""
    return results.select("analysis_id", F.to_json(F.struct("query", "answer", "task_type", "confidence", "metrics", "features")).alias("dossier"))
