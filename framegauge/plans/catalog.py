"""Every registered query of the library's own operators, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_evidence, q_frames, q_grid, q_identity, q_ledger, q_records, q_review, q_scalars, q_streams

MODULES = (q_frames, q_scalars, q_grid, q_identity, q_ledger, q_evidence, q_records, q_review, q_streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
