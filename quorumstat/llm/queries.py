"""One query for each operator of this package, and its SQL where SQL can say the same."""

from __future__ import annotations

from . import conversation_repair, decontaminate, jaccard_join, license_scan, merkle_audit, packing, pii, quality_rules, substring_dedup, suffix_dedup, token_alignment, token_counts, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_merkle_audit": merkle_audit.query,
    "op3_url_filter": url_filter.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_packing": packing.query,
    "op6_pii": pii.query,
    "op7_license_scan": license_scan.query,
    "op8_quality_rules": quality_rules.query,
    "op9_token_counts": token_counts.query,
    "op10_decontaminate": decontaminate.query,
    "op11_suffix_dedup": suffix_dedup.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_token_alignment": token_alignment.query,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_merkle_audit": merkle_audit.SQL,
    "op3_url_filter": url_filter.SQL,
    "op4_jaccard_join": jaccard_join.SQL,
    "op7_license_scan": license_scan.sql(),
    "op8_quality_rules": quality_rules.SQL,
    "op11_suffix_dedup": suffix_dedup.SQL,
}
