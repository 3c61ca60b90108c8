"""All queries of the engine proper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidecurve.plans import base, compaction
from tidecurve.plans import functions, relational, signals, sources  # noqa: F401  (they register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**base.QUERIES, **compaction.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**base.ORACLE, **compaction.ORACLE}
