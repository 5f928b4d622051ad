"""The operators' registered queries, and their DuckDB SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelscope.llm import alignment, infill, langid, licenses, lm_scoring, near_dup, neighbours, packing, pieces, quality, repair, token_counts, toxicity


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        toxicity.op1_toxicity, pieces.op2_piece_encoding, near_dup.op3_minhash_near_dup, packing.op4_harmonic_packing,
        token_counts.op5_token_rollups, neighbours.op6_multi_index, quality.op7_host_quality,
        licenses.op8_license_scan, langid.op9_language_id, repair.op10_repair_shards,
        lm_scoring.op11_context_tree, alignment.op12_pair_alignment, infill.op13_fill_in_middle)}


def sql() -> dict[str, str]:
    return {"op13_fill_in_middle": infill.OP13_SQL, "op3_minhash_near_dup": near_dup.OP3_SQL, "op5_token_rollups": token_counts.OP5_SQL, "op7_host_quality": quality.OP7_SQL}
