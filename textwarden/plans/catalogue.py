"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue_tables, catalogue_text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**catalogue_text.QUERIES, **catalogue_tables.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**catalogue_text.ORACLES, **catalogue_tables.ORACLES}
