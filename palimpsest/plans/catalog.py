"""Relational queries over the memory store: visibility, supersession, joins, catalogue, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, temporal, upsert
from ..operators.ranking import rank_by
from ..sources.tables import read

#: The instant at which the queries look at the memory.
CUTOFF = "2024-09-01 00:00:00"
PROVIDER, MODEL, DIMENSIONS = "localvec", "quartz-embed-512", 512
ENTITY = ["repository_id", "source_type", "source_entity_id"]


def cutoff():
    return F.to_timestamp(F.lit(CUTOFF))


def chunk_ids(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks without the repeats that differ in nothing but indexed_at."""
    return read(spark, d, "document_chunks", "id", *columns).distinct()


def ref_p4_as_of(spark, d):
    return temporal.as_of(read(spark, d, "documents", "doc_id", "id", "available_at", "superseded_at"), cutoff()).select("doc_id", "id")


def ref_k10_supersession(spark, d):
    v = temporal.superseded_by(read(spark, d, "documents", "doc_id", *ENTITY, "available_at"), ENTITY, "available_at", "ended_at")
    return v.select("doc_id", F.coalesce(F.unix_micros("ended_at"), F.lit(-1)).alias("ended_us"))


def ref_p8_live_chunks(spark, d):
    live = read(spark, d, "repositories", "id", "deleted_at").filter("deleted_at is null").select(F.col("id").alias("repository_id"))
    c = chunk_ids(spark, d, "repository_id", "document_id").join(live, "repository_id", "left_semi")
    return c.groupBy("repository_id").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))


def ref_j1_embedded_chunks(spark, d):
    e = read(spark, d, "chunk_embeddings", "chunk_id", "repository_id", "model")
    c = chunk_ids(spark, d, "repository_id", "source_type").withColumnRenamed("id", "chunk_id")
    return e.join(c, ["repository_id", "chunk_id"]).groupBy("model", "source_type").agg(F.count("*").alias("embeddings"), F.countDistinct("chunk_id").alias("chunks"))


def _embeddings(spark, d):
    e = read(spark, d, "chunk_embeddings", "chunk_id", "repository_id", "provider", "model", "dimensions", "content_hash", "embedded_at")
    return upsert.newest(e, ["repository_id", "chunk_id"], "embedded_at", "model", "content_hash")


def ref_j3_stale_embeddings(spark, d):
    c = chunk_ids(spark, d, "repository_id", "content", "content_hash").withColumnRenamed("id", "chunk_id")
    return upsert.stale_embeddings(c, _embeddings(spark, d), PROVIDER, MODEL, DIMENSIONS).select("repository_id", "chunk_id")


def ref_j6_stale_counts(spark, d):
    """What hangs on documents that are superseded at the cutoff, by repository."""
    gone = read(spark, d, "documents", "id", "repository_id", "superseded_at").filter(F.col("superseded_at") <= cutoff()).select(F.col("id").alias("document_id"), "repository_id").distinct()
    c = chunk_ids(spark, d, "document_id").withColumnRenamed("id", "chunk_id")
    e = read(spark, d, "chunk_embeddings", "chunk_id").groupBy("chunk_id").agg(F.count("*").alias("n"))
    j = gone.join(c, "document_id", "left").join(e, "chunk_id", "left")
    return j.groupBy("repository_id").agg(F.countDistinct("document_id").alias("documents"), F.count("chunk_id").alias("chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("embeddings"))


def ref_q8_catalogue(spark, d):
    """Live repositories with the span of their memory, the latest file revision and whether they can be searched."""
    r = read(spark, d, "repositories", "id", "provider", "owner", "name", "default_branch", "deleted_at").filter("deleted_at is null").drop("deleted_at")
    docs = read(spark, d, "documents", "repository_id", "available_at", "indexed_at").groupBy("repository_id").agg(F.min("available_at").alias("first"), F.max("available_at").alias("last"), F.max("indexed_at").alias("indexed"))
    files = read(spark, d, "repository_files", "repository_id", "last_known_commit_sha", "last_synced_at").groupBy("repository_id").agg(F.max_by("last_known_commit_sha", F.struct("last_synced_at", "last_known_commit_sha")).alias("revision"))
    live = chunk_ids(spark, d, "repository_id", "superseded_at").filter("superseded_at is null").withColumnRenamed("id", "chunk_id")
    e = read(spark, d, "chunk_embeddings", "repository_id", "chunk_id", "provider", "model", "dimensions").filter((F.col("provider") == PROVIDER) & (F.col("model") == MODEL) & (F.col("dimensions") == DIMENSIONS))
    ready = e.join(live, ["repository_id", "chunk_id"], "left_semi").select("repository_id").distinct().withColumn("ready", F.lit(True))
    r = r.withColumnRenamed("id", "repository_id")
    for x in (docs, files, ready):
        r = r.join(x, "repository_id", "left")
    return r.select("repository_id", "provider", "owner", "name", "default_branch", "revision", *[F.coalesce(F.unix_micros(c), F.lit(-1)).alias(f"{c}_us") for c in ("first", "last", "indexed")], F.coalesce("ready", F.lit(False)).alias("ready"))


def ref_a1_projections(spark, d):
    return read(spark, d, "chunk_embeddings", "provider", "model", "dimensions").distinct()


def ref_a2_counts(spark, d):
    """Rows and distinct keys of the derived tables."""
    out = None
    for t, k in (("documents", "id"), ("document_chunks", "id"), ("source_relationships", "id"), ("chunk_embeddings", "chunk_id")):
        x = read(spark, d, t, k).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows"), F.countDistinct(k).alias("n_keys"))
        out = x if out is None else out.union(x)
    return out


def ref_j5_local_context(spark, d):
    """For each chunk that is part of a symbol, its two nearest companions in its document."""
    c = chunk_ids(spark, d, "document_id", "chunk_index", "symbol_id", "symbol_name", "parent_symbol").withColumnRenamed("id", "chunk_id")
    a = c.filter("symbol_id is not null").withColumn("query_id", F.lit(0))
    return graph.local_context(a, c).drop("query_id")


def ref_j11_exact_symbols(spark, d):
    """Relationships whose exposed name is one top-level symbol of the target document, with its lines."""
    r = read(spark, d, "source_relationships", "id", "target_document_id", "exposed_name").distinct().filter("exposed_name is not null")
    r = r.select(F.col("id").alias("reference_id"), F.col("target_document_id").alias("document_id"), "exposed_name")
    return graph.exact_symbols(r, chunk_ids(spark, d, "document_id", "symbol_id", "symbol_name", "parent_symbol", "start_line", "end_line"))


def ref_s14_content_hashes(spark, d):
    """Chunks whose recorded hash is not that of their content."""
    c = chunk_ids(spark, d, "content", "content_hash")
    return c.filter(F.sha2("content", 256) != F.col("content_hash")).select("id").distinct()


def ref_u3_dangling(spark, d):
    """Relationships an end of which is no document in force at the cutoff, by which end."""
    r = read(spark, d, "source_relationships", "id", "source_document_id", "target_document_id").distinct()
    docs = temporal.as_of(read(spark, d, "documents", "id", "available_at", "superseded_at"), cutoff()).select("id").distinct()
    a = r.join(docs.withColumnRenamed("id", "source_document_id"), "source_document_id", "left_anti").select("id", F.lit("source").alias("end_name"))
    b = r.join(docs.withColumnRenamed("id", "target_document_id"), "target_document_id", "left_anti").select("id", F.lit("target").alias("end_name"))
    return a.union(b)


def ref_k2_newest_files(spark, d):
    """The next snapshot of the file list: one row a repository and path, the one synchronised last."""
    f = read(spark, d, "repository_files", "id", "repository_id", "path", "size", "last_known_commit_sha", "last_synced_at")
    half = F.to_timestamp(F.lit(CUTOFF))
    old = upsert.newest(f.filter(F.col("last_synced_at") < half), ["repository_id", "path"], "last_synced_at", "last_known_commit_sha", "size", "id")
    new = f.filter(F.col("last_synced_at") >= half)
    order = [F.col(c).desc() for c in ("last_synced_at", "last_known_commit_sha", "size", "id")]
    return upsert.upsert(old, new, ["repository_id", "path"], order).select("id", "repository_id", "path", "size", "last_known_commit_sha")


def ref_k8_sweep(spark, d):
    """Files left after a synchronisation that saw only the newest commit's files of each repository."""
    f = read(spark, d, "repository_files", "id", "repository_id", "path", "last_synced_at").distinct()
    last = f.groupBy("repository_id").agg(F.max("last_synced_at").alias("m"))
    seen = f.join(last, "repository_id").filter(F.col("last_synced_at") == F.col("m")).drop("m")
    return upsert.mark_and_sweep(f, seen, ["repository_id", "path"], "repository_id", "last_synced_at", cutoff()).select("id", "repository_id", "path")


def ref_k7_commits(spark, d):
    """Commits one a repository and sha; the repeats of the log fall together."""
    c = read(spark, d, "commits", "id", "repository_id", "sha", "author", "author_email", "message")
    return rank_by(c, ["repository_id", "sha"], [F.col("id")], "rn", 1).select("repository_id", "sha", "author", "author_email", F.length("message").alias("characters"))


def ref_c0_constraints(spark, d):
    """Rows that break the rules of the schema, by rule."""
    docs = read(spark, d, "documents", "doc_id", "source_type", "path", "commit_sha", "parent_source_type", "parent_source_entity_id", "available_at", "superseded_at")
    rules = {
        "source code without path or commit": "source_type = 'source_code' and (path is null or commit_sha is null)",
        "commit without sha": "source_type = 'commit' and commit_sha is null",
        "half a parent": "(parent_source_type is null) <> (parent_source_entity_id is null)",
        "unknown parent type": "parent_source_type not in ('issue', 'pull_request')",
        "superseded before available": "superseded_at < available_at",
    }
    return docs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(F.expr(v), F.lit(False)).cast("bigint").alias("bad")) for k, v in rules.items()])).alias("r")).groupBy("r.rule").agg(F.sum("r.bad").alias("broken"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("ref_")}
_T = f"timestamptz '{CUTOFF}+00'"
SQL = {
    "ref_p4_as_of": f"select doc_id, id from documents where available_at <= {_T} and (superseded_at is null or superseded_at > {_T})",
    "ref_k10_supersession": """select d.doc_id, coalesce(epoch_us(n.nxt), -1) as ended_us from documents d left join
      (select repository_id, source_type, source_entity_id, available_at, lead(available_at) over (partition by repository_id, source_type, source_entity_id order by available_at) as nxt
       from (select distinct repository_id, source_type, source_entity_id, available_at from documents)) n using (repository_id, source_type, source_entity_id, available_at)""",
    "ref_p8_live_chunks": "select repository_id, count(distinct id) as chunks, count(distinct document_id) as documents from document_chunks where repository_id in (select id from repositories where deleted_at is null) group by 1",
    "ref_j1_embedded_chunks": "select e.model, c.source_type, count(*) as embeddings, count(distinct e.chunk_id) as chunks from chunk_embeddings e join (select distinct id, repository_id, source_type from document_chunks) c on c.id = e.chunk_id and c.repository_id = e.repository_id group by 1, 2",
    "ref_j3_stale_embeddings": f"""with e as (select *, row_number() over (partition by repository_id, chunk_id order by embedded_at desc, model desc, content_hash desc) as rn from chunk_embeddings)
      select c.repository_id, c.id as chunk_id from (select distinct id, repository_id, content_hash from document_chunks) c left join (select * from e where rn = 1) e on e.chunk_id = c.id and e.repository_id = c.repository_id
      where not (e.provider is not distinct from '{PROVIDER}' and e.model is not distinct from '{MODEL}' and e.dimensions is not distinct from {DIMENSIONS} and e.content_hash is not distinct from c.content_hash)""",
    "ref_j6_stale_counts": f"""with g as (select distinct id as document_id, repository_id from documents where superseded_at <= {_T}), c as (select distinct id as chunk_id, document_id from document_chunks), e as (select chunk_id, count(*) as n from chunk_embeddings group by 1)
      select repository_id, count(distinct g.document_id) as documents, count(c.chunk_id) as chunks, coalesce(sum(n), 0)::bigint as embeddings from g left join c using (document_id) left join e using (chunk_id) group by 1""",
    "ref_q8_catalogue": f"""select r.id as repository_id, r.provider, r.owner, r.name, r.default_branch,
      (select last_known_commit_sha from repository_files f where f.repository_id = r.id order by last_synced_at desc, last_known_commit_sha desc limit 1) as revision,
      coalesce((select epoch_us(min(available_at)) from documents x where x.repository_id = r.id), -1) as first_us, coalesce((select epoch_us(max(available_at)) from documents x where x.repository_id = r.id), -1) as last_us,
      coalesce((select epoch_us(max(indexed_at)) from documents x where x.repository_id = r.id), -1) as indexed_us,
      exists (select 1 from chunk_embeddings e join document_chunks c on c.id = e.chunk_id and c.repository_id = e.repository_id where e.repository_id = r.id and c.superseded_at is null and e.provider = '{PROVIDER}' and e.model = '{MODEL}' and e.dimensions = {DIMENSIONS}) as ready
      from repositories r where deleted_at is null""",
    "ref_a1_projections": "select distinct provider, model, dimensions from chunk_embeddings",
    "ref_a2_counts": " union all ".join(f"select '{t}' as table_name, count(*) as n_rows, count(distinct {k}) as n_keys from {t}" for t, k in (("documents", "id"), ("document_chunks", "id"), ("source_relationships", "id"), ("chunk_embeddings", "chunk_id"))),
    "ref_j5_local_context": """with c as (select distinct id as chunk_id, document_id, chunk_index, symbol_id, symbol_name, parent_symbol from document_chunks),
      j as (select a.chunk_id as anchor_chunk, c.chunk_id, coalesce(c.symbol_id = a.symbol_id, false) as same, coalesce(c.symbol_name = a.parent_symbol, false) as parent, c.symbol_name is not null and a.symbol_name is not null as named, abs(c.chunk_index - a.chunk_index) as dist, c.chunk_index
        from c a join c using (document_id) where a.symbol_id is not null and c.chunk_id <> a.chunk_id and (abs(c.chunk_index - a.chunk_index) <= 1 or coalesce(c.symbol_id = a.symbol_id, false) or coalesce(c.symbol_name = a.parent_symbol, false))),
      k as (select *, case when same then 10 when parent then 11 when named then 14 else 18 end as priority, case when same then 'same_symbol_context' when parent then 'parent_symbol' when named then 'structural_neighbor' else 'fallback_line_context' end as reason from j),
      n as (select *, row_number() over (partition by anchor_chunk order by priority, dist, chunk_index, chunk_id)::int as place from k)
      select anchor_chunk, chunk_id, reason, priority, place from n where place <= 2""",
    "ref_j11_exact_symbols": """with s as (select document_id, symbol_name, count(distinct symbol_id) as n, min(symbol_id) as symbol_id, min(start_line) as start_line, max(end_line) as end_line from document_chunks where symbol_id is not null and parent_symbol is null group by 1, 2)
      select r.id as reference_id, s.symbol_id, s.start_line, s.end_line from (select distinct id, target_document_id, exposed_name from source_relationships) r join s on s.document_id = r.target_document_id and s.symbol_name = r.exposed_name where s.n = 1""",
    "ref_s14_content_hashes": "select distinct id from document_chunks where sha256(content) <> content_hash",
    "ref_u3_dangling": f"""with r as (select distinct id, source_document_id, target_document_id from source_relationships), f as (select id from documents where available_at <= {_T} and (superseded_at is null or superseded_at > {_T}))
      select id, 'source' as end_name from r where source_document_id not in (select id from f) union all select id, 'target' from r where target_document_id not in (select id from f)""",
    "ref_k2_newest_files": "select id, repository_id, path, size, last_known_commit_sha from (select *, row_number() over (partition by repository_id, path order by last_synced_at desc, last_known_commit_sha desc, size desc, id desc) as rn from repository_files) where rn = 1",
    "ref_k8_sweep": """with f as (select distinct id, repository_id, path, last_synced_at from repository_files), m as (select repository_id, max(last_synced_at) as m from f group by 1)
      select f.id, f.repository_id, f.path from f join m using (repository_id) where f.last_synced_at = m.m""",
    "ref_k7_commits": "select repository_id, sha, author, author_email, length(message)::int as characters from (select *, row_number() over (partition by repository_id, sha order by id) as rn from commits) where rn = 1",
    "ref_c0_constraints": """select 'source code without path or commit' as rule, count(*) filter (where source_type = 'source_code' and (path is null or commit_sha is null)) as broken from documents
      union all select 'commit without sha', count(*) filter (where source_type = 'commit' and commit_sha is null) from documents
      union all select 'half a parent', count(*) filter (where (parent_source_type is null) <> (parent_source_entity_id is null)) from documents
      union all select 'unknown parent type', count(*) filter (where parent_source_type not in ('issue', 'pull_request')) from documents
      union all select 'superseded before available', count(*) filter (where superseded_at < available_at) from documents""",
}
