"""Queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, chat, decontaminate, exact, language, media, phrases, pieces, resample, simhash, suffix, tokenbin, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_importance_resampling": resample.query,
        "op2_token_binary": tokenbin.query,
        "op3_language_id": language.query,
        "op4_decontamination": decontaminate.query,
        "op5_chat_format": chat.query,
        "op6_suffix_dedup": suffix.query,
        "op7_toxicity": toxicity.query,
        "op8_simhash_near_dedup": simhash.query,
        "op9_media_columns": media.query,
        "op10_sentencepiece": pieces.query,
        "op11_filter_audit": audit.query,
        "op12_phrase_collocations": phrases.query,
        "op13_exact_dedup": exact.query,
    }


def oracle_sql() -> dict[str, str]:
    """Only where SQL can express the operator; the tests hold the others against brute force."""
    return {"op5_chat_format": chat.SQL, "op11_filter_audit": audit.SQL, "op12_phrase_collocations": phrases.SQL, "op13_exact_dedup": exact.SQL}
