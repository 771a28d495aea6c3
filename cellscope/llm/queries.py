"""The registered queries of this package and their DuckDB oracles."""

from __future__ import annotations

from cellscope.llm import (
    chat, exact, fill_middle, fingerprints, jaccard, langid, mixing, packing, pii, quality, resampling, secrets, toxicity,
)

QUERIES = {
    "op1_secret_scans": secrets.op1,
    "op2_chat_formatting": chat.op2,
    "op3_packing": packing.op3,
    "op4_ngram_jaccard": jaccard.op4,
    "op5_pii": pii.op5,
    "op6_language_id": langid.op6,
    "op7_mixing": mixing.op7,
    "op8_quality_rules": quality.op8,
    "op9_fingerprints": fingerprints.op9,
    "op10_toxicity": toxicity.op10,
    "op11_fill_in_middle": fill_middle.op11,
    "op12_importance_resampling": resampling.op12,
    "op13_exact_dedup": exact.op13,
}

ORACLES = {
    "op1_secret_scans": secrets.SQL,
    "op2_chat_formatting": chat.SQL,
    "op5_pii": pii.SQL,
    "op8_quality_rules": quality.SQL,
    "op11_fill_in_middle": fill_middle.SQL,
    "op13_exact_dedup": exact.SQL,
}
