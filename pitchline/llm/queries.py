"""Queries of this subpackage, by name, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this subpackage that has a function of that name.
MODULES = {
    "op1_token_counts": "token_counts",
    "op2_mixing": "mixing",
    "op3_bpe": "bpe",
    "op4_warc": "warc",
    "op5_sharding": "sharding",
    "op6_simhash": "simhash",
    "op7_embeddings": "embeddings",
    "op8_scoring": "scoring",
    "op9_quality_rules": "quality",
    "op10_toxicity": "toxicity",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in MODULES.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
