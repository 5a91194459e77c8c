"""Queries and DuckDB SQL of the corpus operators."""

from __future__ import annotations

from . import centroids, decontaminate, exact_dedup, filter_audit, jaccard_join, langid, license_scan, line_dedup, mixing, sharding, token_counts, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1,
    "op2_decontamination": decontaminate.op2,
    "op3_line_dedup": line_dedup.op3,
    "op4_toxicity": toxicity.op4,
    "op5_language_id": langid.op5,
    "op6_license_scan": license_scan.op6,
    "op7_exact_dedup": exact_dedup.op7,
    "op8_sharding": sharding.op8,
    "op9_ngram_jaccard_join": jaccard_join.op9,
    "op10_mixing": mixing.op10,
    "op11_filter_audit": filter_audit.op11,
    "op12_token_counts": token_counts.op12,
    "op13_centroids": centroids.op13,
}
ORACLE_SQL = {
    "op1_warc": warc.ORACLE,
    "op2_decontamination": decontaminate.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op6_license_scan": license_scan.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_sharding": sharding.ORACLE,
    "op9_ngram_jaccard_join": jaccard_join.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
