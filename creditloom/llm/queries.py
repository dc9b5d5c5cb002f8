"""The registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from creditloom.llm import (
    knn_join,
    line_dedup,
    minhash_dedup,
    mixing,
    periodic_runs,
    quality_model,
    quality_rules,
    secret_scan,
    sentencepiece_fst,
    substring_dedup,
    suffix_dedup,
    url_filter,
    whitening,
)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_sentencepiece": sentencepiece_fst.op5_sentencepiece,
    "op6_minhash_dedup": minhash_dedup.op6_minhash_dedup,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_quality_model": quality_model.op9_quality_model,
    "op10_voronoi_topk": knn_join.op10_voronoi_topk,
    "op11_url_filter": url_filter.op11_url_filter,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_whitening": whitening.op13_whitening,
}
CHECKS = {
    "op1_suffix_dedup": suffix_dedup.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op6_minhash_dedup": minhash_dedup.SQL,
    "op7_secret_scan": secret_scan.SQL,
    "op10_voronoi_topk": knn_join.SQL,
    "op11_url_filter": url_filter.SQL,
}
