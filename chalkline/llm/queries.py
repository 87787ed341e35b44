"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import exact_dedup, licenses, line_dedup, mixing, near_dedup, quality, quotes, sentencepiece_fst, substrings, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat_formatting": quotes.op7_chat_formatting,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_sentencepiece": sentencepiece_fst.op9_sentencepiece,
    "op10_license_scan": licenses.op10_license_scan,
}
SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op5_mixing": mixing.SQL,
    "op7_chat_formatting": quotes.SQL,
    "op8_substring_dedup": substrings.SQL,
}
