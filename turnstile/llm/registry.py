"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from turnstile.llm import (decontaminate, line_dedup, near_dup, neighbours, oracles, pieces, quality, resample, secrets,
                           token_counts, toxicity, url_filter, vector_codes, word_bpe)

QUERIES = {
    "op1_pieces": pieces.op1_pieces,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_secrets": secrets.op3_secrets,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_quality": quality.op8_quality,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_near_dup": near_dup.op10_near_dup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_word_bpe": word_bpe.op12_word_bpe,
    "op13_resample": resample.op13_resample,
}

ORACLE = {
    "op2_url_filter": url_filter.OP2_SQL,
    "op3_secrets": oracles.OP3_SQL,
    "op7_decontaminate": oracles.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op10_near_dup": oracles.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op13_resample": resample.OP13_SQL,
}
