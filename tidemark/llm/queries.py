"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from . import (
    bin_packing,
    conversation_trie,
    decontamination,
    jaccard_join,
    language_model,
    license_scans,
    mixing,
    phrase_dedup,
    quality_rules,
    spelling_variants,
    suffix_dedup,
    toxicity,
    url_filters,
)

QUERIES = {
    "op1_license_scans": license_scans.op1_license_scans,
    "op2_lm_scoring": language_model.op2_lm_scoring,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_phrase_dedup": phrase_dedup.op10_phrase_dedup,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_bin_packing": bin_packing.op12_bin_packing,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}

#: The others are held against brute force, round trips or held-out accuracy in tests/llm.
ORACLES = {
    "op4_quality_rules": quality_rules.ORACLE,
    "op6_url_filters": url_filters.ORACLE,
    "op11_spelling_variants": spelling_variants.ORACLE,
    "op13_conversation_trie": conversation_trie.ORACLE,
}
