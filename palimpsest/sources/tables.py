"""The tables of the memory store, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of the folder, its columns pruned to those named. Zone-less timestamps come as UTC instants."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    fix = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(fix) if fix else df
