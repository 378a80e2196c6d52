"""Registered queries over the driver's tables, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import calendar, feeds, market, parsing, scanning, spending, streams, vouchers  # noqa: F401  (each registers its queries)
from .plans.registry import ORACLES, QUERIES

FLAGSHIP = "setup_scan"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
