"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, katz, langid, pii, simhash, topk, toxicity, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_perspectives": chat.op1,
        "op2_ppm_language": langid.op2,
        "op3_katz": katz.op3,
        "op4_simhash": simhash.op4,
        "op5_decontaminate": decontaminate.op5,
        "op6_nra_topk": topk.op6,
        "op7_pii": pii.op7,
        "op8_bpe": bpe.op8,
        "op9_bloom_cascade": urlfilter.op9,
        "op10_toxicity": toxicity.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_perspectives": chat.OP1_SQL,
        "op6_nra_topk": topk.OP6_SQL,
        "op9_bloom_cascade": urlfilter.OP9_SQL,
    }
