"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_quotes, decontaminate, html_extract, line_dedup, lm_score, media_columns, near_dedup, sentencepiece_codec, substring_dedup, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_media_columns": media_columns.op3_media_columns,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_chat_quotes": chat_quotes.op5_chat_quotes,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_html_extract": html_extract.op9_html_extract,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}
ORACLE_SQL = {
    "op2_decontaminate": decontaminate.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op10_near_dedup": near_dedup.SQL,
}
