"""Small SQL helpers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_sql(spark: SparkSession, text: str, args: list[Any] | dict[str, Any] | None = None) -> DataFrame:
    """SQL over registered views with ``?`` or ``:name`` parameters."""
    return spark.sql(text, args=args)


def first_row(df: DataFrame) -> DataFrame:
    return df.limit(1)


def exists_df(df: DataFrame) -> DataFrame:
    return df.limit(1).agg((F.count("*") > 0).alias("exists"))


def count_df(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))
