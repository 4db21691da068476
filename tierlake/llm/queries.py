"""The queries of this subpackage, by the names under which the entry module registers them."""

from __future__ import annotations

from tierlake.llm import bpe_codec, decontaminate, exact_dedup, fixity, licenses, ngram_join, periodic_runs, quality, sharding, token_counts, topk, toxicity, whitening

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_sharding": sharding.query,
    "op3_quality_classifier": quality.query,
    "op4_benchmark_decontamination": decontaminate.query,
    "op5_license_scans": licenses.query,
    "op6_bpe_encoding_and_decoding": bpe_codec.query,
    "op7_warc": fixity.query,
    "op8_token_counts": token_counts.query,
    "op9_exact_top_k_search": topk.query,
    "op10_toxicity": toxicity.query,
    "op11_exact_dedup": exact_dedup.query,
    "op12_periodic_run_detection": periodic_runs.query,
    "op13_embedding_whitening": whitening.query,
}

#: Where SQL can say what a query computes. The others are tested against a library, brute force or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op2_sharding": sharding.ORACLE_SQL,
    "op4_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op5_license_scans": licenses.ORACLE_SQL,
    "op7_warc": fixity.ORACLE_SQL,
    "op9_exact_top_k_search": topk.ORACLE_SQL,
    "op11_exact_dedup": exact_dedup.ORACLE_SQL,
}
