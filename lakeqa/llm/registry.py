"""QUERIES and ORACLES of this subpackage."""

import corpus_pipeline
from lakeqa.llm import byte_bpe, divergence, exact_dedup, hard_negatives, html_text, language, line_dedup, mixing, near_dedup, quality, secrets, token_files, urls

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_mixing": mixing.op2_mixing,
    "op2_training_order": mixing.op2_training_order,
    "op3_url_filters": urls.op3_url_filters,
    "op3_url_rules": urls.op3_url_rules,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op7_language_id": language.op7_language_id,
    "op9_html_extraction": html_text.op9_html_extraction,
    "op6_token_files": token_files.op6_token_files,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_source_divergence": divergence.op13_source_divergence,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_quality_rules": quality.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op2_training_order": mixing.OP2_ORDER_SQL,
    "op3_url_rules": urls.OP3_RULES_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op11_line_dedup": line_dedup.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
