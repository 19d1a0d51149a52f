"""The corpus queries and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from ridelens.llm import (
    dart_minhash,
    exact_dedup,
    fingerprints,
    language_crf,
    license_scan,
    merkle_manifest,
    mixing,
    packing,
    quality,
    sharding,
    url_rules,
    vector_codes,
    warc,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_language_crf": language_crf.op2_language_crf,
    "op3_packing": packing.op3_packing,
    "op4_mixing": mixing.op4_mixing,
    "op5_warc": warc.op5_warc,
    "op6_dart_minhash": dart_minhash.op6_dart_minhash,
    "op7_url_rules": url_rules.op7_url_rules,
    "op8_quality": quality.op8_quality,
    "op9_sharding": sharding.op9_sharding,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_license_scan": license_scan.op13_license_scan,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op7_url_rules": url_rules.OP7_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_merkle_manifest": merkle_manifest.OP12_SQL,
}
