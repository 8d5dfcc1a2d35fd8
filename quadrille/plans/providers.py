"""Who words an answer (R4, S21): services for which a client is given, and the local report, which is always there.

A client is a function from a column (a struct of query, task_type, metrics, features and limitations) to a column of
text, such as a pandas UDF that asks a service. It gives NULL for rows that it could not answer; those are worded
locally, and their limitations say so.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL = "local"
#: The order in which providers are asked (fixed values).
PROVIDERS = ["groq", "anthropic", "gemini", "openai", LOCAL]
#: The session's setting that names the provider to prefer.
SETTING = "quadrille.provider"

Clients = Mapping[str, Callable[[Column], Column]]


def provider(preferred: str | None = None, available: tuple[str, ...] = (LOCAL,)) -> str:
    """The preferred one if it is there, else the first that is."""
    if preferred in available:
        return preferred
    return next((p for p in PROVIDERS if p in available), LOCAL)


def active(spark: SparkSession, clients: Clients | None = None) -> str:
    return provider((spark.conf.get(SETTING, None) or "").strip().lower() or None, (*(clients or {}), LOCAL))


def mode(name: str) -> str:
    return "LOCAL ANALYSIS" if name == LOCAL else f"REMOTE AI ANALYSIS ({name})"


def listed(spark: SparkSession, clients: Clients | None = None) -> DataFrame:
    """A row for each provider: its kind and mode, whether it is there, and whether it is the one that answers."""
    have, now = {*(clients or {}), LOCAL}, active(spark, clients)
    names = [*PROVIDERS, *sorted(have - set(PROVIDERS))]
    rows = [(n, "local" if n == LOCAL else "remote", mode(n), n in have, n == now) for n in names]
    return spark.createDataFrame(rows, "name string, type string, mode string, available boolean, is_active boolean")


def worded(rows: DataFrame, local: Callable[[], Column], name: str, clients: Clients | None = None) -> DataFrame:
    """Add ``answer`` and ``provider`` to ``rows``, which have the members of the struct; ``local`` words what is left."""
    if name == LOCAL:
        return rows.withColumns({"answer": local(), "provider": F.lit(LOCAL)})
    asked = F.struct("query", "task_type", "metrics", "features", "limitations")
    said = rows.withColumn("said", clients[name](asked))
    note = F.when(F.col("said").isNull(), F.lit(f"[{name} gave no answer; worded locally]"))
    # concat_ws leaves out what is NULL; without either there is no limitation.
    said = said.withColumn("limitations", F.nullif(F.concat_ws(" ", "limitations", note), F.lit("")))
    return said.withColumns({"answer": F.coalesce("said", local()), "provider": F.when(F.col("said").isNull(), LOCAL).otherwise(name)}).drop("said")
