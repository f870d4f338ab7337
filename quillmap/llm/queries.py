"""The contract's queries over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat_format, compression_quality, exact_dedup, merkle_manifest, mixing, multiset_fingerprint, packing, quality_rules,
    secret_scan, simhash_dedup, suffix_dedup, token_counts, vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1,
        "op2_compression_quality": compression_quality.op2,
        "op3_suffix_dedup": suffix_dedup.op3,
        "op4_secret_scan": secret_scan.op4,
        "op5_quality_rules": quality_rules.op5,
        "op6_chat_format": chat_format.op6,
        "op7_mix_sources": mixing.op7,
        "op8_best_fit_packing": packing.op8,
        "op9_simhash_dedup": simhash_dedup.op9,
        "op10_exact_dedup": exact_dedup.op10,
        "op11_multiset_fingerprint": multiset_fingerprint.op11,
        "op12_vector_codes": vector_codes.op12,
        "op13_merkle_manifest": merkle_manifest.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": quality_rules.SQL,
        "op6_chat_format": chat_format.SQL,
        "op7_mix_sources": mixing.SQL,
        "op10_exact_dedup": exact_dedup.SQL,
        "op11_multiset_fingerprint": multiset_fingerprint.SQL,
        "op12_vector_codes": vector_codes.SQL,
        "op13_merkle_manifest": merkle_manifest.SQL,
    }
