"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe,
    byte_bpe,
    decontaminate,
    exact_dedup,
    langid,
    license_scan,
    near_dedup,
    resampling,
    sharding,
    substring_dedup,
    suffix_dedup,
    toxicity,
    whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_sharding": sharding.op4_sharding,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op6_language_id": langid.op6_language_id,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_whitening": whitening.op11_whitening,
        "op12_resampling": resampling.op12_resampling,
        "op13_byte_bpe": byte_bpe.op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact_dedup.ORACLE, "op12_resampling": resampling.ORACLE}
