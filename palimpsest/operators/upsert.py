"""Merging snapshots: upserts, mark and sweep, orphan counts, and stale derived rows.

A table is an immutable snapshot; each operator returns the next one, to be written to a new folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_of


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of `existing` without those whose key is in `new`, and the first of each key of `new` in the order.

    Columns that `new` does not have become null for its rows: a row that was marked as deleted is there again.
    """
    new = first_of(new, keys, order)
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def returning(snapshot: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """What the snapshot has of the rows just upserted; rows without a value in the last column are left out."""
    return snapshot.join(new.select(*keys).distinct(), keys, "left_semi").filter(F.col(columns[-1]).isNotNull()).select(*columns)


def upsert_repository(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Repositories match on (provider, provider_id) or else on (provider, owner, name); a match keeps its id.

    Two equi-joins in place of a join on either.
    """
    by_id = existing.filter("provider_id is not null").select("provider", "provider_id", F.col("id").alias("__by_id"))
    by_name = existing.groupBy("provider", "owner", "name").agg(F.min("id").alias("__by_name"))
    n = new.join(by_id, ["provider", "provider_id"], "left").join(by_name, ["provider", "owner", "name"], "left")
    n = n.withColumn("id", F.coalesce("__by_id", "__by_name", "id")).select(*new.columns)
    # incoming rows that match one repository are one row
    n = first_of(n, ["id"], [F.col(c).desc_nulls_last() for c in ("source_updated_at", *new.columns) if c in new.columns and c != "id"])
    return existing.join(n.select("id"), "id", "left_anti").unionByName(n, allowMissingColumns=True)


def attach_parent(children: DataFrame, parents: DataFrame, keys: list[str], parent_id: str) -> tuple[DataFrame, DataFrame]:
    """(children with their parent's id, orphans): children whose key no parent has are dropped and counted."""
    p = parents.select(*keys, F.col("id").alias(parent_id))
    return children.join(p, keys), children.join(p.select(*keys), keys, "left_anti")


def mark_and_sweep(existing: DataFrame, seen: DataFrame, keys: list[str], scope: str, mark: str, at: Column) -> DataFrame:
    """The next snapshot of a synchronised table: in each scope that was seen, what was seen, marked; other scopes as they are."""
    kept = existing.join(seen.select(scope).distinct(), scope, "left_anti")
    seen = first_of(seen, keys, [F.col(c) for c in seen.columns if c not in keys]).withColumn(mark, at)
    return kept.unionByName(seen, allowMissingColumns=True)


def stale_embeddings(chunks: DataFrame, embeddings: DataFrame, provider: str, model: str, dimensions: int) -> DataFrame:
    """Chunks whose embedding is missing or of another provider, model, size or text; short texts first, for even batches.

    `chunks` has chunk_id, repository_id, content, content_hash.
    """
    e = embeddings.select("chunk_id", "repository_id", F.col("provider").alias("__p"), F.col("model").alias("__m"), F.col("dimensions").alias("__d"), F.col("content_hash").alias("__h"))
    j = chunks.join(e, ["repository_id", "chunk_id"], "left")
    fresh = F.col("__p").eqNullSafe(provider) & F.col("__m").eqNullSafe(model) & F.col("__d").eqNullSafe(dimensions) & F.col("__h").eqNullSafe(F.col("content_hash"))
    return j.filter(~fresh).select(*chunks.columns).repartitionByRange(F.length("content"), "chunk_id").sortWithinPartitions(F.length("content"), "chunk_id")


def newest(df: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """The newest row of each key."""
    return first_of(df, keys, [F.col(at).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ties]])


def cascade(parents: DataFrame, children: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent is left."""
    return children.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")
