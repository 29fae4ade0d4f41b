"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import classifier, dedup, html, jaccard, lm_score, mixing, packing, phrases, quality, token_files, topk, whitening

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "quality_rule_counts": quality.rule_counts,
    "op2_subword_classifier": classifier.op2_subword_classifier,
    "op3_pivot_top_k": topk.op3_pivot_top_k,
    "op4_substring_dedup": dedup.op4_substring_dedup,
    "op5_suffix_array_dedup": dedup.op5_suffix_array_dedup,
    "op6_cross_entropy_difference": lm_score.op6_cross_entropy_difference,
    "op7_hierarchical_mix": mixing.op7_hierarchical_mix,
    "op8_multi_length_packing": packing.op8_multi_length_packing,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "jaccard_links": jaccard.all_jaccard_links,
    "op10_token_files": token_files.op10_token_files,
    "op11_html_main_text": html.op11_html_main_text,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_phrase_collocations": phrases.op13_phrase_collocations,
}

SQL: dict[str, str] = {
    "quality_rule_counts": quality.SQL,
    "op3_pivot_top_k": topk.SQL,
    "op4_substring_dedup": dedup.SQL_WORDS,
    "op5_suffix_array_dedup": dedup.SQL_BYTES,
    "op6_cross_entropy_difference": lm_score.SQL,
    "op7_hierarchical_mix": mixing.SQL,
    "op9_jaccard_join": jaccard.SQL,
    "jaccard_links": jaccard.SQL_LINKS,
    "op11_html_main_text": html.SQL,
    "op13_phrase_collocations": phrases.SQL,
}
