"""Sharding by jump consistent hashing, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_text, fresh, ranked, table

SHARDS = 16
#: Hash blocks per shard for numbering rows; a shard's rows are never sorted in one task.
BLOCKS = 512
#: Multiplier of the 64-bit linear congruential step of jump hashing (fixed value).
LCG = 2862933555777941757

_M22 = (1 << 22) - 1


def _step(key: Column) -> Column:
    """key * LCG + 1 modulo 2**64, in 22-bit limbs, as Spark's own product raises on overflow."""
    k = [key.bitwiseAND(F.lit(_M22)), F.shiftrightunsigned(key, 22).bitwiseAND(F.lit(_M22)), F.shiftrightunsigned(key, 44)]
    c = [LCG & _M22, (LCG >> 22) & _M22, LCG >> 44]
    t0 = k[0] * c[0] + 1
    t1 = k[0] * c[1] + k[1] * c[0] + F.shiftright(t0, 22)
    t2 = k[0] * c[2] + k[1] * c[1] + k[2] * c[0] + F.shiftright(t1, 22)
    high = F.shiftleft(t2.bitwiseAND(F.lit((1 << 20) - 1)), 44)
    return high.bitwiseOR(F.shiftleft(t1.bitwiseAND(F.lit(_M22)), 22)).bitwiseOR(t0.bitwiseAND(F.lit(_M22)))


def jump(key: Column, shards: int) -> Column:
    """Jump consistent hash of a long key into ``shards`` buckets; every step moves on, so ``shards`` steps suffice."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def move(state: Column, _: Column) -> Column:
        going = state["j"] < shards
        k = _step(state["k"])
        j = F.floor((state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + 1).cast("double"))).cast("long")
        return F.when(going, F.struct(k.alias("k"), state["j"].alias("b"), j.alias("j"))).otherwise(state)

    start = F.struct(key.cast("long").alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, move, lambda s: s["b"].cast("int"))


def key_of(df: DataFrame, keys: list[str]) -> Column:
    """A single integer key is used as it is, anything else by its 64-bit hash; null counts as 0."""
    if len(keys) == 1 and df.schema[keys[0]].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.coalesce(F.col(keys[0]).cast("long"), F.lit(0).cast("long"))
    return F.xxhash64(*keys)


def assign_shards(df: DataFrame, keys: list[str] | str = "doc_id", shards: int = SHARDS, shard: str = "shard", grown: str | None = "grown_shard") -> DataFrame:
    """Add the shard of each row, and with ``grown`` its shard once one more is appended. No shuffle.

    The key and the number of shards alone decide: repeated keys share a shard, null keys share that of 0.
    An empty table stays empty; columns already named like the new ones are replaced.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    k = key_of(df, keys)
    out = df.withColumn(shard, jump(k, shards))
    return out.withColumn(grown, jump(k, shards + 1)) if grown else out


def slots(df: DataFrame, keys: list[str], shard: str = "shard", slot: str = "slot", blocks: int = BLOCKS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps; equal rows get different numbers."""
    rest = [F.col(c) for c in df.columns if c != shard]
    return ranked(df, [shard], rest, rest, slot, blocks)


def write_shards(df: DataFrame, path: str, keys: list[str] | str = "doc_id", shards: int = SHARDS, files: int = 8) -> None:
    """Write whole rows in one folder per shard; each shard is cut into ``files`` hash pieces, so no task holds one."""
    piece = fresh(df.columns + ["shard"], "piece")[0]
    rows = assign_shards(df, keys, shards, grown=None).withColumn(piece, F.pmod(F.xxhash64(*df.columns), F.lit(files)))
    rows.repartition(shards * files, "shard", piece).drop(piece).write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        crc_text(F.col("text")).alias("text_crc32"),
    )
    placed = slots(assign_shards(docs), ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
