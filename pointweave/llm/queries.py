"""The subpackage's registered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bag_minhash, byte_bpe, exact_dedup, grid_codes, html_mincut, packing, permutation_index, quality_rules, secret_scan, substring_dedup, token_alignment, token_counts, weak_quality

_OPERATORS = {
    "op1_quality_rules": quality_rules,
    "op2_html_mincut": html_mincut,
    "op3_secret_scan": secret_scan,
    "op4_best_fit_packing": packing,
    "op5_bag_minhash": bag_minhash,
    "op6_substring_dedup": substring_dedup,
    "op7_token_counts": token_counts,
    "op8_exact_dedup": exact_dedup,
    "op9_weak_quality": weak_quality,
    "op10_byte_bpe": byte_bpe,
    "op11_permutation_index": permutation_index,
    "op12_grid_codes": grid_codes,
    "op13_token_alignment": token_alignment,
}

QUERIES = {name: module.query for name, module in _OPERATORS.items()}
ORACLE_SQL = {name: module.SQL for name, module in _OPERATORS.items() if module.SQL}
