"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import collocation, decontamination, divergence, exact_dedup, html_main, line_dedup, mixing, near_dedup, quality_rules, quotation, resampling, token_counts, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quotation": quotation.op2_quotation,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_minhash": near_dedup.op4_minhash,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quality": resampling.op6_quality,
    "op7_html": html_main.op7_html,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_divergence": divergence.op12_divergence,
    "op13_collocations": collocation.op13_collocations,
}

SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op11_quality_rules": quality_rules.OP11_SQL,
    "op12_divergence": divergence.OP12_SQL,
    "op13_collocations": collocation.OP13_SQL,
}
