"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary_output, exact_dedup, fingerprints, mixing, packing, pii, quality, repeats, sharding, simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_binary_output": binary_output.op2_binary_output,
        "op3_pii": pii.op3_pii,
        "op4_mixing": mixing.op4_mixing,
        "op4_schedule": mixing.op4_schedule,
        "op5_repeats": repeats.op5_repeats,
        "op6_packing": packing.op6_packing,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_sharding": sharding.op8_sharding,
        "op9_simhash": simhash.op9_simhash,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op4_mixing": mixing.SQL}
