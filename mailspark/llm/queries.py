"""The registered queries of this package: one per operator, and the SQL where SQL can state the same rows."""

from __future__ import annotations

from mailspark.llm import (chat, collocations, language, margins, mining, mixing, partenum, quality, records, repeats,
                           scoring, templates, wordpiece)

QUERIES = {
    "op1_benchmark_leaks": templates.op1_benchmark_leaks,
    "op2_training_records": records.op2_training_records,
    "op3_perspectives": chat.op3_perspectives,
    "op4_lm_scores": scoring.op4_lm_scores,
    "op5_mixing_sources": mixing.op5_mixing_sources,
    "op6_ngram_jaccard": partenum.op6_ngram_jaccard,
    "op7_repeated_passages": repeats.op7_repeated_passages,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_language_id": language.op9_language_id,
    "op10_token_counts": wordpiece.op10_token_counts,
    "op11_quality_scores": margins.op11_quality_scores,
    "op12_hard_negatives": mining.op12_hard_negatives,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op3_perspectives": chat.ORACLE,
    "op5_mixing_sources": mixing.ORACLE,
    "op12_hard_negatives": mining.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
