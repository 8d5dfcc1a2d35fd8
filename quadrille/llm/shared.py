"""Scratch tables, size-checked joins and hashes that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key-only table up to which it may be broadcast (16 MB of longs).
BROADCAST_ROWS = 1_000_000

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; an own one only where none is set, in local
    mode. Elsewhere an own folder would be on the driver's disk alone, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-quadrille-")
    return _own[app]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: its lineage ends there and outlives executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/quadrille/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a count proves ``df`` small; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fold(key: str, of: int) -> Column:
    """crc32 of the key written as text, modulo ``of``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


def crc_text(col: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(col, F.lit("")), "utf-8"))


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for helper columns that clash with none of the ``taken`` ones."""
    have, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def ranked(df: DataFrame, group: list[str], spread: list[Column], order: list[Column], out: str, blocks: int) -> DataFrame:
    """Number the rows of each group 0, 1, ... without ever bringing a whole group together.

    Rows are dealt to ``blocks`` hash blocks of their group, numbered inside the block, and moved up by the
    sizes of the blocks before. A hot group is thus cut into ``blocks`` sorts; only the counts, at most
    ``blocks`` per group, are summed in order. ``df`` is read twice, so save it first when it is dear.
    """
    from pyspark.sql import Window as W

    block, base = fresh(df.columns + [out], "block", "base")
    dealt = df.withColumn(block, F.pmod(F.xxhash64(*spread), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy(*group, block).agg(F.count(F.lit(1)).alias(base))
    before = W.partitionBy(*group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(g).alias(f"{block}_{i}") for i, g in enumerate(group)], F.col(block).alias(f"{block}_b"), F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    inside = W.partitionBy(*group, block).orderBy(*order)
    numbered = dealt.withColumn(out, F.row_number().over(inside).cast("long") - 1)
    on = [F.col(g).eqNullSafe(F.col(f"{block}_{i}")) for i, g in enumerate(group)] + [F.col(block) == F.col(f"{block}_b")]
    joined = numbered.join(sized(sizes, 200_000), on)
    return joined.withColumn(out, F.col(out) + F.col(base)).select(*df.columns, out)
