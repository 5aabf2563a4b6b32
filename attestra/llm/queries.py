"""The queries of this subpackage and their SQL, for the repository's entry module."""

from __future__ import annotations

from . import bpe_automaton, exact_dedup, fill_in_middle, jaccard_join, ppm, quality_rules, row_pattern, secret_scan, source_mix, suffix_dedup, token_counts, token_files, warc_zip

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_secret_scan": secret_scan.query,
    "op3_ppm": ppm.query,
    "op4_token_files": token_files.query,
    "op5_warc_zip": warc_zip.query,
    "op6_quality_rules": quality_rules.query,
    "op7_source_mix": source_mix.query,
    "op8_bpe_automaton": bpe_automaton.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_fill_in_middle": fill_in_middle.query,
    "op12_token_counts": token_counts.query,
    "op13_row_pattern": row_pattern.query,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_secret_scan": secret_scan.ORACLE,
    "op5_warc_zip": warc_zip.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op13_row_pattern": row_pattern.ORACLE,
}
