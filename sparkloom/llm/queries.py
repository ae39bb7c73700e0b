"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from . import decontam, embed_dedup, license_scan, mixing, ngram_join, packing, quality, sharding, token_count, toxicity

QUERIES = {
    "op1_packing": packing.query,
    "op2_toxicity": toxicity.query,
    "op3_embedding_dedup": embed_dedup.query,
    "op4_token_count": token_count.query,
    "op5_ngram_join": ngram_join.query,
    "op6_quality": quality.query,
    "op7_license_scan": license_scan.query,
    "op8_mixing": mixing.query,
    "op9_sharding": sharding.query,
    "op10_decontamination": decontam.query,
}

ORACLES = {
    "op3_embedding_dedup": embed_dedup.SQL,
    "op5_ngram_join": ngram_join.SQL,
    "op7_license_scan": license_scan.SQL,
    "op8_mixing": mixing.SQL,
    "op9_sharding": sharding.SQL,
    "op10_decontamination": decontam.SQL,
}
