"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_simhash, op2_topk, op3_pii, op4_langid, op5_decontam, op6_mixing, op7_suffix, op8_tokens, op9_html, op10_substring


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash.query,
        "op2_topk": op2_topk.query,
        "op3_pii": op3_pii.query,
        "op4_langid": op4_langid.query,
        "op5_decontam": op5_decontam.query,
        "op6_mixing": op6_mixing.query,
        "op7_suffix": op7_suffix.query,
        "op8_tokens": op8_tokens.query,
        "op9_html": op9_html.query,
        "op10_substring": op10_substring.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": op2_topk.SQL, "op5_decontam": op5_decontam.SQL, "op6_mixing": op6_mixing.SQL, "op7_suffix": op7_suffix.SQL, "op10_substring": op10_substring.SQL}
