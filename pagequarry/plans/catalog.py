"""Every query of the library by name, without those of the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagequarry.plans import retrieval


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(retrieval.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(retrieval.ORACLES)
