"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from ringlet.llm import byte_bpe, exact_dedup, hnsw, mixing, near_dedup, pii, quality, sharding, toxicity, url_filter

QUERIES = {
    "op1_url_ngrams": url_filter.op1_query,
    "op2_exact_stream": exact_dedup.op2_query,
    "op3_weak_pii": pii.op3_query,
    "op4_hnsw_shards": hnsw.op4_query,
    "op5_byte_bpe": byte_bpe.op5_query,
    "op6_virtual_slots": sharding.op6_query,
    "op7_quadratic_quality": quality.op7_query,
    "op8_toxic_crf": toxicity.op8_query,
    "op9_circulant_minhash": near_dedup.op9_query,
    "op10_mix_blocks": mixing.op10_query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_stream": exact_dedup.OP2_SQL,
    "op9_circulant_minhash": near_dedup.OP9_SQL,
}
