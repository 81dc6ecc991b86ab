"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import collocations, decontaminate, exact_dedup, html_text, language_id, near_dup, pii, piece_codec, source_divergence, substring_dedup, token_count, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_pii": pii.op4_pii,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_token_count": token_count.op6_token_count,
        "op7_sentencepiece": piece_codec.op7_sentencepiece,
        "op8_language_id": language_id.op8_language_id,
        "op9_html_text": html_text.op9_html_text,
        "op10_minhash": near_dup.op10_minhash,
        "op11_source_divergence": source_divergence.op11_source_divergence,
        "op12_collocations": collocations.op12_collocations,
        "op13_toxicity": toxicity.op13_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op2_substring_dedup": substring_dedup.SQL,
        "op3_decontaminate": decontaminate.SQL,
        "op10_minhash": near_dup.SQL,
        "op11_source_divergence": source_divergence.SQL,
        "op12_collocations": collocations.SQL,
    }
