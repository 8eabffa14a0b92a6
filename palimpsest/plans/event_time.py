"""Problem 3: each request answered with what was in force at its cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal as tm
from ..sources.tables import read

ENTITY = ["repository_id", "source_type", "source_entity_id"]


def versions(documents: DataFrame) -> DataFrame:
    """Versions of entities with `ended_at`, the instant at which a later version had become available."""
    return tm.superseded_by(documents, ENTITY, "available_at", "ended_at")


def answers(requests: DataFrame, documents: DataFrame, relationships: DataFrame) -> DataFrame:
    """Rows (request_id, cutoff, kind, record_id, available_at), kind 'version' or 'relationship'.

    A relationship counts if its source is a version matched by the request and its target document is in
    force at the cutoff too. Requests with a null cutoff or entity get nothing; repeated requests, versions
    and relationships give one row each; versions that became available at one instant are all returned.
    """
    v = versions(documents.select("id", *ENTITY, "available_at", "superseded_at").distinct()).withColumnRenamed("id", "version_id")
    r = requests.select("request_id", *ENTITY, "cutoff").distinct()
    hit = tm.as_of_join(r, v.withColumnRenamed("available_at", "version_available_at"), ENTITY, ENTITY, "cutoff", "version_available_at", "superseded_at", ["version_id", "version_available_at"], until="ended_at")
    hit = hit.select("request_id", "cutoff", "version_id", "version_available_at").distinct()
    rel = relationships.select("id", "source_document_id", "target_document_id", "available_at", "superseded_at").distinct()
    rel = rel.withColumnsRenamed({"id": "relationship_id", "available_at": "relationship_available_at", "superseded_at": "relationship_end"})
    out = tm.as_of_join(hit.select("request_id", "cutoff", "version_id"), rel, ["version_id"], ["source_document_id"], "cutoff", "relationship_available_at", "relationship_end", ["relationship_id", "target_document_id", "relationship_available_at"])
    targets = v.select(F.col("version_id").alias("target_version"), F.col("available_at").alias("target_available_at"), "superseded_at", "ended_at")
    out = tm.as_of_join(out, targets, ["target_document_id"], ["target_version"], "cutoff", "target_available_at", "superseded_at", [], until="ended_at")
    a = hit.select("request_id", "cutoff", F.lit("version").alias("kind"), F.col("version_id").alias("record_id"), F.col("version_available_at").alias("available_at"))
    b = out.select("request_id", "cutoff", F.lit("relationship").alias("kind"), F.col("relationship_id").alias("record_id"), F.col("relationship_available_at").alias("available_at"))
    return a.unionByName(b.distinct())


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return answers(
        read(spark, d, "memory_requests", "request_id", *ENTITY, "cutoff"),
        read(spark, d, "documents", "id", *ENTITY, "available_at", "superseded_at"),
        read(spark, d, "source_relationships", "id", "source_document_id", "target_document_id", "available_at", "superseded_at"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("request_id", "record_id").distinct()


def p3_latest_version(spark: SparkSession, d: str) -> DataFrame:
    """One version a request: of those in force the one available last, then the greatest id."""
    v = _answers(spark, d).filter("kind = 'version'")
    v = tm.latest_fact(v, ["request_id", "cutoff"], [F.col("available_at").desc(), F.col("record_id").desc()])
    return v.select("request_id", F.col("record_id").alias("document_id"), F.unix_micros("available_at").alias("available_us"))


_SQL = """
with v as (select distinct id, repository_id, source_type, source_entity_id, available_at, superseded_at from documents),
n as (select distinct repository_id, source_type, source_entity_id, available_at from documents where available_at is not null),
e as (select *, lead(available_at) over (partition by repository_id, source_type, source_entity_id order by available_at) as ended_at from n),
w as (select v.*, e.ended_at from v join e using (repository_id, source_type, source_entity_id, available_at)),
r as (select distinct request_id, repository_id, source_type, source_entity_id, cutoff from memory_requests),
hit as (select distinct r.request_id, r.cutoff, w.id, w.available_at from r join w using (repository_id, source_type, source_entity_id)
  where w.available_at <= r.cutoff and (w.superseded_at is null or w.superseded_at > r.cutoff) and (w.ended_at is null or w.ended_at > r.cutoff)),
rel as (select distinct h.request_id, s.id from hit h join source_relationships s on s.source_document_id = h.id
  join w t on t.id = s.target_document_id
  where s.available_at <= h.cutoff and (s.superseded_at is null or s.superseded_at > h.cutoff)
  and t.available_at <= h.cutoff and (t.superseded_at is null or t.superseded_at > h.cutoff) and (t.ended_at is null or t.ended_at > h.cutoff))
"""

QUERIES = {"p3_found": p3_found, "p3_latest_version": p3_latest_version}
SQL = {
    "p3_found": _SQL + "select request_id, id as record_id from hit union select request_id, id as record_id from rel",
    "p3_latest_version": _SQL + """select request_id, id as document_id, epoch_us(available_at) as available_us from
  (select *, row_number() over (partition by request_id, cutoff order by available_at desc, id desc) as rn from hit) where rn = 1""",
}
