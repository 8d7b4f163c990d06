"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from ferrymass.llm import byte_bpe, chat, decontam, exact_dedup, langid, line_templates, ngram_join, phrases, pii, quality, quality_rules, runs, substring_dedup

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_line_templates": line_templates.op4_line_templates,
    "op5_langid": langid.op5_langid,
    "op6_decontaminate": decontam.op6_decontaminate,
    "op7_quality": quality.op7_quality,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_suffix_dedup": substring_dedup.op9_suffix_dedup,
    "op10_chat": chat.op10_chat,
    "op11_phrases": phrases.op11_phrases,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLES = {
    "op10_chat": chat.SQL,
    "op11_phrases": phrases.SQL,
    "op12_quality_rules": quality_rules.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
}
