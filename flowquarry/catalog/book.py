"""Register of queries: a Spark callable and, where SQL can say it, the check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowquarry.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
_STORED: dict[tuple, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            CHECKS[name] = sql.strip()
        return function
    return register


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that several queries share, written once per session to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def round_to(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in cols})
