"""All registered queries of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, control, indexes, more, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = retrieval.Q | analytics.Q | control.Q | more.Q | indexes.Q
ORACLES: dict[str, str] = retrieval.SQL | analytics.SQL | control.SQL | more.SQL | indexes.SQL
