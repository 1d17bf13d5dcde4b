"""Operators for training-data pipelines. Nothing else in the library imports this package."""

from . import (
    bpe,
    cube_mixing,
    exact_dedup,
    hamming_topk,
    language_id,
    length_histogram,
    secret_scan,
    simhash,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_cube_mixing": cube_mixing.op5_cube_mixing,
    "op6_hamming_topk": hamming_topk.op6_hamming_topk,
    "op7_token_counts": length_histogram.op7_token_counts,
    "op8_bpe": bpe.op8_bpe,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_language_id": language_id.op10_language_id,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op2_secret_scan": secret_scan.ORACLE_SQL,
    "op3_url_filters": url_filter.ORACLE_SQL,
    "op6_hamming_topk": hamming_topk.ORACLE_SQL,
}
