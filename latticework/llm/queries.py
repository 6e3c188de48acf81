"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, licenses, lines, packing, pii, quality, repeats, rollups, simhash, token_files

Query = Callable[[SparkSession, str], DataFrame]

_ALL: tuple[Query, ...] = (
    quality.op1_quality_rules,
    token_files.op2_token_files,
    rollups.op3_token_rollups,
    repeats.op4_block_anchor_repeats,
    licenses.op5_license_templates,
    pii.op6_disclosure,
    packing.op7_best_fit_packing,
    simhash.op8_simhash_near_duplicates,
    lines.op9_line_spread,
    decontam.op10_benchmark_windows,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.OP1_SQL, "op4_block_anchor_repeats": repeats.OP4_SQL, "op5_license_templates": licenses.OP5_SQL, "op9_line_spread": lines.OP9_SQL}
