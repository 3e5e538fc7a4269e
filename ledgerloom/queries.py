"""The registry of named queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import acks, authorship, bootstrap, evidence, ledger, recall, retrieval, telemetry, turns
from ledgerloom.sources import imports

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [retrieval, ledger, telemetry, recall, turns, authorship, evidence, bootstrap, acks, imports]


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
