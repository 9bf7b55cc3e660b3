"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_extract, langid, license_scan, line_dedup, lm, packing, simhash, suffix_dedup

QUERIES = {
    "op1_html_extraction": html_extract.op1_html_extraction,
    "op2_packing": packing.op2_packing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_simhash_dedup": simhash.op6_simhash_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_language_id": langid.op8_language_id,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_lm_scoring": lm.op10_lm_scoring,
}

ORACLE_SQL = {
    "op3_line_dedup": line_dedup.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op5_benchmark_decontamination": decontaminate.SQL,
    "op7_license_scan": license_scan.SQL,
    "op9_suffix_dedup": suffix_dedup.SQL,
}
