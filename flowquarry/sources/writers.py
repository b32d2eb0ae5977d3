"""CSV, Parquet and JSON sinks. Every sink writes a folder from all tasks at once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with header; list columns become ", "-joined text."""
    flat = df.select(*[
        F.array_join(F.col(f"`{f.name}`"), ", ").alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
    flat.write.mode("overwrite").options(header=True, escape='"').csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, files_each: int = 16) -> str:
    """Parquet, optionally in folders by column values, with at most ``files_each`` files a folder.

    Rows are first gathered by value and a salt, so that not every task writes a file into every folder and a value that
    holds most rows is still written by several tasks.
    """
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return path
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, MapType)]), F.lit(files_each)))
    salted.repartition(*[F.col(f"`{c}`") for c in partition_by], "_salt").drop("_salt").write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_summary(spark: SparkSession, parts: dict, path: str) -> str:
    """One nested JSON record from small parts: numbers, or one-row tables.

    Only summary tables (one row each) belong here; anything longer has its own sink.
    """
    record = {}
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            row = part.first()
            part = row.asDict(recursive=True) if row else {}
        record[name] = part
    spark.createDataFrame([(json.dumps(record, default=str),)], "value string").write.mode("overwrite").text(path)
    return path
