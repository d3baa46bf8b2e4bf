"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import jaccard, licenses, mining, mixing, packing, pieces, quality, quantiles, records, rules, secrets, topk, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_warc": warc.op2_warc,
        "op3_licenses": licenses.op3_licenses,
        "op4_quality": quality.op4_quality,
        "op5_pieces": pieces.op5_pieces,
        "op6_jaccard": jaccard.op6_jaccard,
        "op7_secrets": secrets.op7_secrets,
        "op8_host_rules": rules.op8_host_rules,
        "op9_topk": topk.op9_topk,
        "op10_records": records.op10_records,
        "op11_hard_negatives": mining.op11_hard_negatives,
        "op12_quantiles": quantiles.op12_quantiles,
        "op13_mixing": mixing.op13_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.SQL,
        "op8_host_rules": rules.SQL,
        "op9_topk": topk.SQL,
        "op11_hard_negatives": mining.SQL,
        "op13_mixing": mixing.SQL,
    }
