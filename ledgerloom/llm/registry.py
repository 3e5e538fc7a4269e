"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, chat, collocate, ctw, htmltext, jaccard, langid, media, mixing, repair, topk, toxicity, urlfilter

MODULES = [toxicity, urlfilter, media, langid, mixing, bpe, htmltext, ctw, topk, jaccard, chat, collocate, repair]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
