"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from . import chroma, extraction, langid, licenses, mixing, packing, quality, repeats, simhash, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_suffix_dedup": repeats.op3_suffix_dedup,
    "op4_language_mixture": langid.op4_language_mixture,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_chroma_fingerprints": chroma.op6_chroma_fingerprints,
    "op7_quality_cascade": quality.op7_quality_cascade,
    "op8_simhash": simhash.op8_simhash,
    "op9_toxicity_cnn": toxicity.op9_toxicity_cnn,
    "op10_extract_content": extraction.op10_extract_content,
}

ORACLE_SQL = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op7_quality_cascade": quality.OP7_SQL,
}
