"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from docstrata.llm.chat import OP2_SQL, op2_chat
from docstrata.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from docstrata.llm.language import op3_language_id
from docstrata.llm.media import op9_media
from docstrata.llm.mixing import OP5_SQL, op5_mix
from docstrata.llm.negatives import OP11_SQL, op11_hard_negatives
from docstrata.llm.packing import op1_pack
from docstrata.llm.quality import op7_quality
from docstrata.llm.secrets import op8_secrets
from docstrata.llm.simhash import op6_simhash
from docstrata.llm.spelling import op12_spelling
from docstrata.llm.substring import op10_substring_dedup
from docstrata.llm.urls import OP13_SQL, op13_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pack": op1_pack,
        "op2_chat": op2_chat,
        "op3_language_id": op3_language_id,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_mix": op5_mix,
        "op6_simhash": op6_simhash,
        "op7_quality": op7_quality,
        "op8_secrets": op8_secrets,
        "op9_media": op9_media,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_spelling": op12_spelling,
        "op13_url_filter": op13_url_filter,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op5_mix": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op13_url_filter": OP13_SQL}
