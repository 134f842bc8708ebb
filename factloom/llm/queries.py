"""Queries of the training-data operators, one an operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import chat_formatting, decontamination, language_id, lm_scoring, packing, quality, simhash, token_counts, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_lm_scoring": lm_scoring.op3_lm_scoring,
        "op4_benchmark_decontamination": decontamination.op4_benchmark_decontamination,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_chat_formatting": chat_formatting.op6_chat_formatting,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_language_id": language_id.op8_language_id,
        "op9_warc_derivatives": warc.op9_warc_derivatives,
        "op10_token_counts": token_counts.op10_token_counts,
        "pipeline": run,
    }


def oracle_sql() -> dict[str, str]:
    """Only what SQL expresses on whole tables; the others are tested against brute force."""
    return {"op6_chat_formatting": chat_formatting.OP6_SQL, "op9_warc_derivatives": warc.OP9_SQL}
