"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, conversations, decontaminate, html_extract, katz, linededup, mixing, quality, sharding, simhash, substring_dedup, surrogates


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": linededup.op1_line_dedup,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_sharding": sharding.op4_sharding,
        "op5_html_text": html_extract.op5_html_text,
        "op6_surrogates": surrogates.op6_surrogates,
        "op7_simhash": simhash.op7_simhash,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_katz": katz.op9_katz,
        "op10_mixing": mixing.op10_mixing,
        "op11_alignment": alignment.op11_alignment,
        "op12_conversations": conversations.op12_conversations,
        "op13_bpe": bpe.op13_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": linededup.OP1_SQL, "op4_sharding": sharding.OP4_SQL, "op8_decontaminate": decontaminate.OP8_SQL}
