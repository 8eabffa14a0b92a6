"""The current text of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read

FILE_COLUMNS = ["id", "repository_id", "path", "language", "extension", "size", "last_known_commit_sha", "last_synced_at"]


def latest_files(files: DataFrame) -> DataFrame:
    """One row a file id: the one synchronised last; ties by commit, size and path. Rows without id are left out."""
    w = Window.partitionBy("id").orderBy(F.col("last_synced_at").desc_nulls_last(), F.col("last_known_commit_sha").desc_nulls_last(), F.col("size").desc_nulls_last(), F.col("path").desc_nulls_last())
    return files.filter(F.col("id").isNotNull()).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def current_texts(files: DataFrame, documents: DataFrame, how: str = "inner") -> DataFrame:
    """Files with `text`, that of the document of the file's id and last known commit.

    A document taken in twice has one text; if texts differ, the greatest wins. With how = 'left' files
    without text come with null.
    """
    d = documents.filter(F.col("source_entity_id").isNotNull() & F.col("commit_sha").isNotNull() & F.col("text").isNotNull())
    d = d.select(F.col("source_entity_id").alias("__id"), F.col("commit_sha").alias("__sha"), "text")
    f = latest_files(files)
    out = f.join(d, (f.id == d["__id"]) & (f.last_known_commit_sha == d["__sha"]), how).drop("__id", "__sha")
    # twice-ingested documents repeat the join's row; a file id has one commit here, and by both the join has placed the rows
    w = Window.partitionBy("id", "last_known_commit_sha").orderBy(F.col("text").desc_nulls_last())
    return out.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def load(spark: SparkSession, d: str, how: str = "inner", endings: list[str] | None = None, name: str | None = None) -> DataFrame:
    """Files with their texts; with endings only files whose path ends in one of them, with name only files of that name."""
    f = read(spark, d, "repository_files", *FILE_COLUMNS)
    if endings:
        f = f.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(endings))
    if name:
        f = f.filter((F.col("path") == name) | F.col("path").endswith("/" + name))
    docs = read(spark, d, "documents", "source_type", "source_entity_id", "commit_sha", "path", "text").filter("source_type = 'source_code'")
    if name:
        docs = docs.filter((F.col("path") == name) | F.col("path").endswith("/" + name))
    return current_texts(f, docs.drop("source_type", "path"), how)
