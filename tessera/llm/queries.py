"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classifier, decontam, license_scan, packing, pii, quality_rules, sentence_spans, sharding, simhash, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_dice": license_scan.op1_license_dice,
        "op2_simhash_covering": simhash.op2_simhash_covering,
        "op3_interval_expansion": suffix_dedup.op3_interval_expansion,
        "op4_jump_hash": sharding.op4_jump_hash,
        "op5_quality_cascade": quality_rules.op5_quality_cascade,
        "op6_prefix_filter": decontam.op6_prefix_filter,
        "op7_information_content": pii.op7_information_content,
        "op8_sentence_spans": sentence_spans.op8_sentence_spans,
        "op9_island_packing": packing.op9_island_packing,
        "op10_nb_svm": classifier.op10_nb_svm,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_interval_expansion": suffix_dedup.ORACLE,
        "op4_jump_hash": sharding.ORACLE,
        "op5_quality_cascade": quality_rules.ORACLE,
        "op6_prefix_filter": decontam.ORACLE,
    }
