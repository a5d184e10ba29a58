"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, language, line_dedup, mixing, packing, quality, quality_rules, sharding, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_line_dedup": line_dedup.query,
    "op3_simhash": simhash.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_sharding": sharding.query,
    "op6_packing": packing.query,
    "op7_quality_rules": quality_rules.query,
    "op8_language_id": language.query,
    "op9_quality_classifier": quality.query,
    "op10_source_mixing": mixing.query,
    "shards_of_2k": sharding.query_of_2k,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_sharding": sharding.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "shards_of_2k": sharding.oracle(sharding.SMALL_LIMIT),
}
