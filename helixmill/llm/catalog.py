"""The registered queries of this subpackage and their DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, fim, html_text, jaccard, licenses, packing, pii, quality, sharding, suffix_dedup, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_shard": sharding.op2_shard,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_quality": quality.op4_quality,
        "op5_jaccard": jaccard.op5_jaccard,
        "op6_licenses": licenses.op6_licenses,
        "op7_main_text": html_text.op7_main_text,
        "op8_pack": packing.op8_pack,
        "op9_chat_format": chat.op9_chat_format,
        "op10_decontaminate": decontam.op10_decontaminate,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_chat_format": chat.OP9_SQL, "op10_decontaminate": decontam.OP10_SQL, "op11_fill_in_middle": fim.OP11_SQL}
