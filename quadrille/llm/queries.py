"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op8_chat_formatting
from .decontamination import op4_decontamination
from .jaccard import op2_jaccard_join
from .language import op5_language_id
from .licenses import OP7_SQL, op7_license_scan
from .linededup import OP6_SQL, op6_line_dedup
from .neighbours import op10_nearest_neighbours
from .packing import op9_packing
from .repair import OP13_SQL, op13_conversation_repair
from .secretscan import op12_secret_scan
from .sharding import op1_sharding
from .spelling import OP11_SQL, op11_spelling_variants
from .toxicity import op3_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_toxicity": op3_toxicity,
        "op4_decontamination": op4_decontamination,
        "op5_language_id": op5_language_id,
        "op6_line_dedup": op6_line_dedup,
        "op7_license_scan": op7_license_scan,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_packing": op9_packing,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_secret_scan": op12_secret_scan,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_line_dedup": OP6_SQL,
        "op7_license_scan": OP7_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_secret_scan": op12_secret_scan,
        "op13_conversation_repair": OP13_SQL,
    }
