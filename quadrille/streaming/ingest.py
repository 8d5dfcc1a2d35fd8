"""Files that arrive over time, as an incremental form of upload (S8): a file stream whose batches are judged and filed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.raster import below, sniffed, uploads

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Each new file below ``path`` once, at most ``files_per_batch`` in a batch, as raster.files() gives them."""
    rows = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.select("path", below(F.col("path"), path).alias("scene_id"), "length", "content", sniffed(F.col("content"), F.col("path")).alias("format"))


def ingest(spark: SparkSession, path: str, taken: str, refused: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append files to the table ``taken`` or, with the reason, ``refused``. A batch that is repeated after a failure
    takes the place of its first try, as each batch is a folder of its own."""

    def put(batch: DataFrame, number: int) -> None:
        good, bad = uploads(batch)
        good.write.mode("overwrite").parquet(f"{taken}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{refused}/batch={number}")

    writer = arriving(spark, path).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
