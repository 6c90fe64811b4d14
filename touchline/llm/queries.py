"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

from touchline.llm import op1_toxicity, op2_packing, op3_license, op4_exact_dedup, op5_mixing, op6_ngram_join, op7_secrets, op8_sharding, op9_quality_rules, op10_quality_classifier, op11_tokenizer_alignment, op12_html_extraction, op13_prefix_trie

_MODULES = [op1_toxicity, op2_packing, op3_license, op4_exact_dedup, op5_mixing, op6_ngram_join, op7_secrets, op8_sharding, op9_quality_rules, op10_quality_classifier, op11_tokenizer_alignment, op12_html_extraction, op13_prefix_trie]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
