"""Queries and DuckDB SQL of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, langid, mixing, near_join, ogg, pii, quality, secrets, sharding

MODULES = (quality, near_join, mixing, decontaminate, secrets, pii, langid, html_text, sharding, ogg)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
