"""Named queries over the supplied tables, each with the SQL that yields the same rows.

``QUERIES`` maps a name to a function of (spark, sf_dir), ``ORACLE`` to SQL over the same tables. Numbers are
rounded on both sides, since sums of doubles depend on their order. The modules below add their own part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import image_queries, model_queries, relational_queries, source_queries, tabular_queries, temporal_queries, text_queries

_PARTS = (tabular_queries, temporal_queries, text_queries, image_queries, model_queries, relational_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean the value series of each user, cut windows and give each a risk band."""
    return temporal_queries.risk_bands(spark, sf_dir)
