"""The registered queries of the numbered operators, with SQL where it can say the same."""

from __future__ import annotations

from estatelens.llm import (
    best_fit, chat_format, embedding_dedup, filter_audit, language_id, license_scan, line_dedup, ngram_join, packing, quality_rules, secret_scan,
    sentencepiece_scan, source_divergence,
)

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_sentencepiece": sentencepiece_scan.op4_sentencepiece,
    "op5_language_id": language_id.op5_language_id,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_packing": packing.op8_packing,
    "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_source_divergence": source_divergence.op12_source_divergence,
    "op13_best_fit": best_fit.op13_best_fit,
}

#: Operators 2, 4, 5, 8 and 13 rest on a forest, tokenizers and a compressor, which SQL cannot say; tests hold them against plain versions.
ORACLES = {
    "op1_license_scan": license_scan.ORACLE.strip(),
    "op3_secret_scan": secret_scan.ORACLE.strip(),
    "op6_chat_format": chat_format.ORACLE.strip(),
    "op7_embedding_dedup": embedding_dedup.ORACLE.strip(),
    "op9_ngram_jaccard": ngram_join.ORACLE.strip(),
    "op10_line_dedup": line_dedup.ORACLE.strip(),
    "op11_filter_audit": filter_audit.ORACLE.strip(),
    "op12_source_divergence": source_divergence.ORACLE.strip(),
}
