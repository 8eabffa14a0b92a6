"""The jobs that build a memory: stages with their events, persisting documents and relationships, embedding what is stale."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunking, temporal, upsert
from .ranking import first_of

ENTITY = ["repository_id", "source_type", "source_entity_id"]
VERSION = [*ENTITY, "source_version"]


class StageError(RuntimeError):
    """A stage of a job failed; the cause is chained."""

    def __init__(self, stage: str, cause: Exception):
        super().__init__(f"stage {stage} failed: {cause}")
        self.stage = stage


@dataclass
class Stages:
    """Runs named stages in order and tells a listener of each start, completion with its milliseconds, and failure."""

    tell: Callable[[dict], None] = lambda event: None
    events: list[dict] = field(default_factory=list)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        self._say({"stage": name, "event": "started"})
        try:
            yield
        except Exception as e:
            self._say({"stage": name, "event": "failed", "ms": int(1000 * (time.monotonic() - began)), "error": str(e)[:500]})
            raise StageError(name, e) from e
        self._say({"stage": name, "event": "completed", "ms": int(1000 * (time.monotonic() - began))})

    def _say(self, event: dict) -> None:
        self.events.append(event)
        self.tell(event)


def persist_documents(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The next snapshot of the versions: new ones replace their equals, and every version ends where a strictly later one begins.

    A version that ended before anything later was known keeps its end, if that is earlier. Running it again on its
    own result changes nothing.
    """
    both = upsert.upsert(existing, new, VERSION, [F.col("available_at").desc(), F.col("content_hash")])
    ended = temporal.superseded_by(both, ENTITY, "available_at", "__later")
    return ended.withColumn("superseded_at", F.least("superseded_at", "__later")).drop("__later")


def replace_chunks(existing: DataFrame, documents: DataFrame, new: DataFrame) -> DataFrame:
    """The next snapshot of the chunks: those of rebuilt documents are replaced whole, the others stay; no chunk outlives its document.

    `documents` are all versions kept (id), `new` the chunks of rebuilt ones (document_id, chunk_index, ...).
    """
    kept = existing.join(new.select("document_id").distinct(), "document_id", "left_anti")
    kept = kept.join(documents.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_semi")
    return kept.unionByName(first_of(new, ["document_id", "chunk_index"], [F.col("content_hash")]), allowMissingColumns=True)


def close_intervals(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the interval of their document's version."""
    d = first_of(documents.select("id", "available_at", "superseded_at"), ["id"], [F.col("available_at").desc(), F.col("superseded_at").desc_nulls_first()])
    d = d.select(F.col("id").alias("document_id"), F.col("available_at").alias("__from"), F.col("superseded_at").alias("__to"))
    return chunks.drop("available_at", "superseded_at").join(d, "document_id").withColumnsRenamed({"__from": "available_at", "__to": "superseded_at"})


def persist_relationships(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Relationships of rebuilt repositories are the new ones alone, those of others stay."""
    kept = existing.join(new.select("repository_id").distinct(), "repository_id", "left_anti")
    return kept.unionByName(first_of(new, ["id"], [F.col(c).desc_nulls_last() for c in new.columns if c != "id"]), allowMissingColumns=True)


def mark_indexed(repositories: DataFrame, ids: DataFrame, column: str, at: Column) -> DataFrame:
    """Repositories with the time in the given column for those in `ids` (id)."""
    m = ids.select("id").distinct().withColumn("__at", at)
    return repositories.join(m, "id", "left").withColumn(column, F.coalesce("__at", column)).drop("__at")


def reconcile(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(counts by repository, documents, chunks, embeddings) without the source files that `current` (repository_id, path) no longer has."""
    stale = documents.filter("source_type = 'source_code'").join(current.select("repository_id", "path").distinct(), ["repository_id", "path"], "left_anti")
    ids = stale.select(F.col("id").alias("document_id"), "repository_id").distinct()
    gone = chunks.join(ids.select("document_id"), "document_id", "left_semi")
    n = ids.join(chunks.select("document_id", F.col("id").alias("chunk_id")), "document_id", "left").join(embeddings.select("chunk_id", F.lit(1).alias("e")), "chunk_id", "left")
    counts = n.groupBy("repository_id").agg(F.countDistinct("document_id").alias("documents"), F.countDistinct("chunk_id").alias("chunks"), F.count("e").alias("embeddings"))
    left = documents.join(ids.select(F.col("document_id").alias("id")), "id", "left_anti")
    return counts, left, chunks.join(ids.select("document_id"), "document_id", "left_anti"), embeddings.join(gone.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")


def build_chunks(documents: DataFrame) -> DataFrame:
    """Chunks of document versions with identities and their versions' intervals."""
    c = chunking.with_identity(chunking.chunk_documents(documents)).withColumnRenamed("chunk_id", "id")
    about = documents.select(F.col("id").alias("document_id"), "repository_id", "source_type", "source_entity_id", "path", "available_at", "superseded_at").dropDuplicates(["document_id"])
    return c.join(about, "document_id")


#: An embedding provider: texts to vectors, batch by batch. `name`, `model` and `dimensions` say what it gives.
@dataclass(frozen=True)
class Embedder:
    name: str
    model: str
    dimensions: int
    embed: Callable[[list[str]], list[list[float]]]


def checked(provider: Embedder, texts: list[str]) -> list[list[float]]:
    """The provider's vectors; a wrong number or size of them, or a value that is not finite, is an error."""
    import math

    out = provider.embed(texts)
    if len(out) != len(texts):
        raise ValueError(f"{provider.name} gave {len(out)} vectors for {len(texts)} texts")
    for v in out:
        if len(v) != provider.dimensions:
            raise ValueError(f"{provider.name} gave a vector of {len(v)} values, not {provider.dimensions}")
        if not all(math.isfinite(x) for x in v):
            raise ValueError(f"{provider.name} gave a value that is not finite")
    return out


def embed_stale(chunks: DataFrame, embeddings: DataFrame, provider: Embedder, batch: int = 64) -> DataFrame:
    """New embeddings of the chunks whose own is missing or stale, short texts first, in batches of the provider's calls.

    `chunks` has chunk_id, repository_id, content, content_hash. What is written of the result is not stale in the
    next run, so a run that was cut off is taken up by running it again.
    """
    if not 1 <= batch <= 256:
        raise ValueError("batch must be between 1 and 256")
    stale = upsert.stale_embeddings(chunks, embeddings, provider.name, provider.model, provider.dimensions)

    def run(frames):
        for pdf in frames:
            vectors = [v for i in range(0, len(pdf), batch) for v in checked(provider, pdf["content"].fillna("").tolist()[i : i + batch])]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "repository_id": pdf["repository_id"], "content_hash": pdf["content_hash"], "embedding": vectors})

    e = stale.mapInPandas(run, "chunk_id string, repository_id string, content_hash string, embedding array<float>")
    return e.withColumns({"provider": F.lit(provider.name), "model": F.lit(provider.model), "dimensions": F.lit(provider.dimensions)})


def batch_lengths(chunks: DataFrame, batch: int) -> DataFrame:
    """Least, greatest and summed length of the texts of each batch of stale chunks, in the order they are sent: one row a batch."""
    from pyspark.sql import Window

    c = chunks.select("repository_id", "chunk_id", F.length("content").alias("n"))
    place = F.row_number().over(Window.partitionBy("repository_id").orderBy("n", "chunk_id")) - 1
    c = c.withColumn("batch", F.floor(place / batch).cast("int"))
    return c.groupBy("repository_id", "batch").agg(F.min("n").alias("shortest"), F.max("n").alias("longest"), F.sum("n").alias("characters"))
