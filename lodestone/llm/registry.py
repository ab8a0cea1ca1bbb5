"""The operators' queries and their DuckDB counterparts, for the driver's entry module."""

from __future__ import annotations

import corpus_pipeline
from lodestone.llm import byte_dedup, decontamination, divergence, language_id, lm_scoring, near_dedup, packing, simhash_dedup, spelling, substring_dedup, topk_search, toxicity, warc


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_language_id": language_id.op1_language_id,
        "op2_lm_scoring": lm_scoring.op2_lm_scoring,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_topk": topk_search.op4_topk,
        "op5_byte_dedup": byte_dedup.op5_byte_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_warc": warc.op8_warc,
        "op9_pack": packing.op9_pack,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_simhash_dedup": simhash_dedup.op13_simhash_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": decontamination.OP3_SQL,
        "op4_topk": topk_search.OP4_SQL,
        "op5_byte_dedup": byte_dedup.OP5_SQL,
        "op7_near_dedup": near_dedup.OP7_SQL,
        "op8_warc": warc.OP8_SQL,
        "op10_substring_dedup": substring_dedup.OP10_SQL,
        "op11_spelling_variants": spelling.OP11_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
    }
