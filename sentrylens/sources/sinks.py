"""Sinks for result tables, splits and thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """SNK1: overwrite a result table (parquet, csv with header, or json)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_split(df: DataFrame, path: str, features: Sequence[str], y: str = "y", split: str = "split") -> None:
    """SNK2: train and test rows in one table, one folder per part, features in order."""
    write_table(df.select(*features, y, split), path, partition_by=[split])


def write_thresholds(df: DataFrame, path: str) -> None:
    """SNK3: threshold record (a row) with the time it was written."""
    write_table(df.withColumn("written_at", F.current_timestamp()), path, "json")
