"""Annotation collections (S16-S20) and the catalogue of scenes (S9, S10), as tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import written

QUESTIONS = "questions array<struct<id:string,image_id:string,type:string,question:string>>"
ANSWERS = "answers array<struct<id:string,answer:string>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, by Spark's own file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def available(spark: SparkSession, root: str) -> bool:
    """A collection is there if its root is."""
    return exists(spark, root)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file; where there is none, no rows of the same schema."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def join_answers(questions: DataFrame, answers: DataFrame, id: str = "id", order: str | None = None) -> DataFrame:
    """Questions with their answer, '' where there is none; of several answers to an id the last one (by ``order``)
    counts. Questions without a type are ``general``."""
    last = answers.groupBy(id).agg(F.max_by("answer", order).alias("answer")) if order else answers.dropDuplicates([id])
    out = questions.join(last, id, "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    return out.withColumn("type", F.coalesce("type", F.lit("general"))) if "type" in out.columns else out


def rsvqa(spark: SparkSession, root: str) -> DataFrame:
    """image_id and its question-answer pairs, in the order of the file."""
    q = _json(spark, f"{root}/questions.json", QUESTIONS).select(F.posexplode("questions").alias("place", "q")).select("place", "q.*")
    a = _json(spark, f"{root}/answers.json", ANSWERS).select(F.posexplode("answers").alias("at", "a")).select("at", "a.*")
    return per_image(join_answers(q, a, order="at"))


def per_image(rows: DataFrame) -> DataFrame:
    """image_id and the array ``qa`` of its questions, answers and types, by ``place``."""
    pairs = F.array_sort(F.collect_list(F.struct("place", "question", "answer", "type")))
    return rows.groupBy("image_id").agg(F.transform(pairs, lambda p: F.struct(p["question"].alias("question"), p["answer"].alias("answer"), p["type"].alias("type"))).alias("qa"))


def cdvqa(spark: SparkSession, root: str) -> DataFrame:
    """pair_id and its question-answer maps."""
    return _json(spark, f"{root}/change_qa.json", "pairs map<string,array<map<string,string>>>").select(F.explode("pairs").alias("pair_id", "qa"))


def vrsbench(spark: SparkSession, root: str) -> DataFrame:
    """sample_id and its annotation as JSON text, whatever its form."""
    path = f"{root}/vrsbench_annotations.json"
    if not exists(spark, path):
        return spark.createDataFrame([], "sample_id string, annotation string")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("sample_id", "annotation"))


#: Land-cover classes (fixed values).
LAND_COVER = [
    "Continuous urban fabric",
    "Discontinuous urban fabric",
    "Industrial or commercial units",
    "Road and rail networks",
    "Port areas",
    "Airports",
    "Non-irrigated arable land",
    "Permanently irrigated land",
    "Rice fields",
    "Vineyards",
    "Fruit trees and berry plantations",
    "Pastures",
    "Complex cultivation patterns",
    "Land principally occupied by agriculture",
    "Broad-leaved forest",
    "Coniferous forest",
    "Mixed forest",
    "Natural grassland",
    "Moors and heathland",
    "Sclerophyllous vegetation",
    "Transitional woodland/shrub",
    "Beaches, dunes, sands",
    "Bare rock",
    "Sparsely vegetated areas",
    "Burnt areas",
    "Inland marshes",
    "Peat bogs",
    "Salt marshes",
    "Salines",
    "Intertidal flats",
    "Water courses",
    "Water bodies",
    "Coastal lagoons",
    "Estuaries",
    "Sea and ocean",
]


def known_labels(labels: Column, classes: list[str]) -> Column:
    """The labels that are classes, in their order."""
    return F.filter(labels, lambda x: x.isin(classes))


def land_cover(spark: SparkSession, root: str, classes: list[str] | None = None) -> DataFrame:
    """patch_id, its labels that are classes, and its .tif files. Hidden folders are passed over."""
    if not exists(spark, root):
        return spark.createDataFrame([], "patch_id string, labels array<string>, files array<string>")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    named = listed.select("path", F.element_at(parts, -2).alias("patch_id"), F.element_at(parts, -1).alias("name")).filter(~F.startswith("patch_id", F.lit(".")))
    tifs = named.filter(F.lower("name").endswith(".tif")).groupBy("patch_id").agg(F.array_sort(F.collect_list("name")).alias("files"))
    meta = spark.read.schema("labels array<string>").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_labels_metadata.json").json(root)
    tagged = meta.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("patch_id"), known_labels(F.col("labels"), classes or LAND_COVER).alias("labels"))
    return tagged.join(tifs, "patch_id", "full").select("patch_id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))


# --- scenes ------------------------------------------------------------------------------------------------------


#: Identifiers up to which they are sent to the names.
FEW = 200_000


def stretches(names: DataFrame, sizes: list[int]) -> DataFrame:
    """The rows of ``names`` with each stretch of ``sizes`` characters of the name, as column identifier."""
    longs = names.withColumn("size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).filter(F.length("name") >= F.col("size"))
    placed = longs.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("name") - F.col("size") + 1)))
    return placed.select(*names.columns, F.substring("name", F.col("at"), F.col("size")).alias("identifier"))


def resolve(scenes: DataFrame, wanted: DataFrame, aliases: dict[str, str] | None = None, few: int = FEW) -> DataFrame:
    """For each ``identifier`` of ``wanted`` the scene whose name contains it, samples before uploads, then by name;
    an alias where none does. ``scenes`` has name and source (0 sample, 1 upload; last where it is null). Empty identifiers match nothing.

    A name contains an identifier if it is one of the name's stretches of that length; so they meet by equality, and
    the first name of each stretch is found before a shuffle and after it. A stretch that all names have (a common
    extension, say) thus brings a row from each task, and the work grows with the names' letters and the number of
    different lengths alone. Up to ``few`` identifiers are sent to the names; more meet their first names by a shuffle.
    """
    asked = written(wanted.select("identifier").filter("identifier <> ''").distinct(), "identifiers")
    sizes = [r[0] for r in asked.select(F.length("identifier")).distinct().collect()]
    # A name that stands there often counts once.
    named = scenes.groupBy("name").agg(F.min("source").alias("source"))
    parts = stretches(named, sizes)
    if sent := asked.limit(few + 1).count() <= few:
        parts = parts.join(F.broadcast(asked), "identifier")
    best = parts.groupBy("identifier").agg(F.min(F.struct(F.isnull("source").alias("unknown"), "source", "name")).alias("b")).select("identifier", F.col("b.name").alias("name"))
    out = asked.join(best if sent else best.hint("merge"), "identifier", "left")
    if aliases:
        told = F.create_map(*[F.lit(x) for p in aliases.items() for x in p])
        out = out.withColumn("name", F.coalesce("name", F.element_at(told, F.col("identifier"))))
    return out


#: Descriptors of the library's own scenes (fixed values): id, title, modality, pair.
SAMPLES = [
    ("coast", "Coastal scene with near infrared", "MULTISPECTRAL", None),
    ("before", "River fields, first date", "OPTICAL", "after"),
    ("after", "River fields, second date", "OPTICAL", "before"),
    ("harbour", "Harbour, visible bands", "OPTICAL", "radar"),
    ("radar", "Harbour, backscatter", "SAR", "harbour"),
]


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLES, "id string, title string, modality string, pair_id string")


def pairs(catalogue: DataFrame) -> DataFrame:
    """Each sample beside the one it names."""
    a, b = catalogue.alias("a"), catalogue.alias("b")
    return a.join(b, F.col("a.pair_id") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.id").alias("pair_id"), F.col("b.title").alias("pair_title"))
