"""Queries that build and keep a memory: records to documents, versions, chunks and relationships, and what is stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import files as fl
from ..functions import vectors as vx
from ..operators import assess, chunking, edges, graph, memory, ranking, records, upsert
from ..sources import landed
from ..sources.tables import read
from .catalog import CUTOFF, DIMENSIONS, PROVIDER, _embeddings, chunk_ids, cutoff, ref_q8_catalogue

POSTS = ["issue", "issue_comment", "pull_request", "review"]


def _records(spark, d, kind: str) -> DataFrame:
    """The posts of one kind as the records they came from: numbers, states and branches stand in for the provider's own."""
    r = read(spark, d, "documents", "doc_id", "repository_id", "source_type", "source_entity_id", "parent_source_entity_id", "title", "text", "source", "occurred_at", "available_at").filter(F.col("source_type") == kind)
    number = (F.col("doc_id") % 1000).cast("int")
    parent = F.col("parent_source_entity_id")
    return r.select("doc_id", "repository_id", F.col("source_entity_id").alias("id"), F.lit("code host").alias("provider"), F.concat(F.col("doc_id").cast("string"), F.lit("/a b")).alias("provider_id"), number.alias("number"), "title", F.col("text").alias("body"), F.col("source").alias("author"), F.when(F.col("doc_id") % 2 == 0, "open").otherwise("closed").alias("state"), F.lit("main").alias("base_branch"), F.lit("work").alias("head_branch"), F.col("occurred_at").alias("created_at"), F.col("available_at").alias("source_updated_at"), parent.alias("issue_id"), parent.alias("pull_request_id"), number.alias("issue_number"), number.alias("pull_request_number"))


def _commits(spark, d) -> DataFrame:
    c = read(spark, d, "commits", "id", "repository_id", "sha", "message", "author", "authored_at", "committed_at")
    return ranking.first_of(c, ["repository_id", "sha"], [F.col("id")])


def _posts(spark, d) -> list[DataFrame]:
    make = {"issue": records.issue_documents, "issue_comment": records.comment_documents, "pull_request": records.pull_request_documents, "review": records.review_documents}
    return [make[k](_records(spark, d, k)) for k in POSTS]


def ref_g1_documents(spark, d):
    """Posts as documents: reference, version, heading and text."""
    u = records.document_union(*_posts(spark, d))
    return u.select("source_type", "source_entity_id", "source_reference", "source_version", F.coalesce("title", F.lit("")).alias("title"), F.sha2("text", 256).alias("text_hash"))


def ref_n1_commit_documents(spark, d):
    c = records.commit_documents(_commits(spark, d))
    return c.select("source_entity_id", "source_reference", "title", F.sha2("text", 256).alias("text_hash"), F.unix_micros("available_at").alias("available_us"))


def ref_u2_union(spark, d):
    """All documents of the memory by kind, with their identities."""
    u = records.document_union(*_posts(spark, d), records.commit_documents(_commits(spark, d)))
    return u.groupBy("source_type").agg(F.count("*").alias("documents"), F.countDistinct("id").alias("ids"), F.min("id").alias("first_id"))


def _versions(spark, d) -> DataFrame:
    return read(spark, d, "documents", "id", *memory.ENTITY, "source_version", "content_hash", "available_at", "superseded_at", "indexed_at")


def ref_k10_persisted(spark, d):
    """The versions after what was indexed late has been persisted over what was there before."""
    v = _versions(spark, d)
    order = [F.col("available_at").desc(), F.col("content_hash"), F.col("superseded_at").desc_nulls_first()]
    late = F.col("indexed_at") >= cutoff()
    old, new = (ranking.first_of(v.filter(c), memory.VERSION, order) for c in (~late, late))
    p = memory.persist_documents(old, new)
    return p.select(*memory.ENTITY, "source_version", F.unix_micros("available_at").alias("available_us"), F.coalesce(F.unix_micros("superseded_at"), F.lit(-1)).alias("ended_us"))


def ref_k10_intervals(spark, d):
    """Chunks with the interval of their document's version."""
    c = memory.close_intervals(chunk_ids(spark, d, "document_id"), read(spark, d, "documents", "id", "available_at", "superseded_at"))
    return c.select("id", F.unix_micros("available_at").alias("from_us"), F.coalesce(F.unix_micros("superseded_at"), F.lit(-1)).alias("to_us"))


def ref_k10_replaced_chunks(spark, d):
    """Chunks after the documents indexed late were rebuilt with one chunk each; chunks without document go."""
    docs = read(spark, d, "documents", "id", "indexed_at")
    late = docs.filter(F.col("indexed_at") >= cutoff()).select("id").distinct()
    new = late.select(F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit("new:"), "id").alias("id"), F.lit("").alias("content_hash"))
    return memory.replace_chunks(chunk_ids(spark, d, "document_id", "chunk_index", "content_hash"), docs, new).select("id", "document_id", "chunk_index")


def ref_k11_relationships(spark, d):
    """Relationships after the repositories with late ones were rebuilt from these alone."""
    r = read(spark, d, "source_relationships", "id", "repository_id", "available_at").distinct()
    return memory.persist_relationships(r, r.filter(F.col("available_at") >= F.to_timestamp(F.lit("2024-10-01")))).select("id", "repository_id")


def ref_k12_reconciled(spark, d):
    """What goes with the source files that the file list no longer has: those of each repository's first half of paths stay."""
    files = read(spark, d, "repository_files", "repository_id", "path").filter(F.col("path") < "p").distinct()
    docs = read(spark, d, "documents", "id", "repository_id", "source_type", "path").distinct()
    return memory.reconcile(docs, chunk_ids(spark, d, "document_id"), read(spark, d, "chunk_embeddings", "chunk_id"), files)[0]


def ref_k9_marked(spark, d):
    """When each repository was indexed, after a run over those that have documents."""
    r = read(spark, d, "repositories", "id", "indexed_at")
    has = read(spark, d, "documents", "repository_id").select(F.col("repository_id").alias("id"))
    return memory.mark_indexed(r, has, "indexed_at", cutoff()).select("id", F.coalesce(F.unix_micros("indexed_at"), F.lit(-1)).alias("indexed_us"))


def ref_j2_parents(spark, d):
    """Comments and reviews joined with the post they belong to, in the same repository."""
    v = read(spark, d, "documents", "doc_id", "repository_id", "source_type", "source_entity_id", "parent_source_type", "parent_source_entity_id")
    p = v.select("repository_id", F.col("source_type").alias("parent_source_type"), F.col("source_entity_id").alias("parent_source_entity_id")).distinct()
    return v.filter("parent_source_entity_id is not null").join(p, ["repository_id", "parent_source_type", "parent_source_entity_id"]).groupBy("repository_id", "source_type").agg(F.count("*").alias("n"))


def ref_k3_orphans(spark, d):
    """Comments and reviews whose post is no issue."""
    v = read(spark, d, "documents", "doc_id", "repository_id", "source_type", "source_entity_id", "parent_source_entity_id")
    p = v.filter("source_type = 'issue'").select("repository_id", F.col("source_entity_id").alias("parent_source_entity_id"), F.col("source_entity_id").alias("id")).distinct()
    return upsert.attach_parent(v.filter("parent_source_entity_id is not null").select("doc_id", "repository_id", "parent_source_entity_id"), p, ["repository_id", "parent_source_entity_id"], "parent")[1].select("doc_id")


def _sources(spark, d) -> DataFrame:
    s = read(spark, d, "documents", "id", "repository_id", "source_type", "path", "commit_sha", "text", "available_at", "superseded_at").filter("source_type = 'source_code' and path is not null")
    s = s.filter((F.col("available_at") <= cutoff()) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > cutoff())))
    return ranking.first_of(s, ["repository_id", "path"], [F.col("available_at").desc(), F.col("id")])


def ref_j9_resolution(spark, d):
    """The file that each relative import of the current sources means."""
    s = _sources(spark, d)
    b = chunking.extract_imports(s).select("document_id", "specifier").distinct().join(s.select(F.col("id").alias("document_id"), "repository_id", "path"), "document_id")
    b = b.select(F.concat("document_id", F.lit(" "), "specifier").alias("import_id"), "document_id", "repository_id", edges.directory(F.col("path")).alias("directory"), "specifier")
    return graph.resolve_specifiers(b, s).join(b.select("import_id", "document_id", "specifier"), "import_id").select("document_id", "specifier", "path")


def ref_g6_symbols(spark, d):
    """Symbols of the current sources, members with their parents."""
    s = _sources(spark, d).withColumn("language", fl.language(F.col("path")))
    return chunking.extract_symbols(s)


def _edges(spark, d):
    s = _sources(spark, d)
    symbols = chunk_ids(spark, d, "document_id", "symbol_id", "symbol_name", "symbol_kind", "parent_symbol", "start_line", "end_line")
    return edges.build(chunking.extract_imports(s), s, symbols)


def ref_g8_edges(spark, d):
    """Which current sources import or re-export from which."""
    return _edges(spark, d)[0].select("source_document_id", "target_document_id", "relationship_type", "source_path", "target_path").distinct()


def ref_g8_bindings(spark, d):
    """The relationships of the current sources, one a binding, in their canonical order."""
    return edges.canonical(_edges(spark, d)[0]).select("id", "source_document_id", "target_document_id", "imported_name", "binding_kind", "resolution", "target_symbol", "source_start_line", "reason")


def ref_a12_edge_counts(spark, d):
    return _edges(spark, d)[1]


def ref_a22_batches(spark, d):
    c = chunk_ids(spark, d, "repository_id", "content", "content_hash").withColumnRenamed("id", "chunk_id")
    from .catalog import MODEL

    return memory.batch_lengths(upsert.stale_embeddings(c, _embeddings(spark, d), PROVIDER, MODEL, DIMENSIONS), 64)


def ref_q13_embedded(spark, d):
    """Embeddings of what is stale, by the local provider; their length is 1, or 0 for a text without words."""
    from .catalog import MODEL

    c = chunk_ids(spark, d, "repository_id", "content", "content_hash").withColumnRenamed("id", "chunk_id")
    n = 64
    local = memory.Embedder(PROVIDER, MODEL, n, lambda texts: [vx.hash_embedding(t, n) for t in texts])
    e = memory.embed_stale(c, _embeddings(spark, d), local)
    return e.select("repository_id", "chunk_id", F.round(vx.norm(F.col("embedding")), 4).alias("length"))


def ref_q12_build(spark, d):
    """The memory of all posts and commits: documents united, given their intervals, and cut into chunks; chunks by kind."""
    u = records.document_union(*_posts(spark, d), records.commit_documents(_commits(spark, d))).withColumn("superseded_at", F.lit(None).cast("timestamp"))
    v = memory.persist_documents(u.limit(0), u).withColumn("language", fl.language(F.col("path")))
    c = memory.build_chunks(v)
    return c.groupBy("source_type").agg(F.count("*").alias("chunks"), F.countDistinct("id").alias("ids"), F.countDistinct("document_id").alias("documents"), F.count_if(F.col("superseded_at").isNotNull()).alias("superseded"))


def ref_t6_catalogue(spark, d):
    """The catalogue in its order."""
    c = ref_q8_catalogue(spark, d)
    place = ranking.rank_by(c.withColumn("__all", F.lit(0)), ["__all"], [F.col("provider"), F.col("owner"), F.col("name"), F.col("repository_id")], "place")  # a repository a row: few
    return place.select("repository_id", "place")


def ref_u5_revisions(spark, d):
    """The distinct revisions of each repository's documents."""
    e = read(spark, d, "documents", "repository_id", "commit_sha").filter("commit_sha is not null").withColumnRenamed("repository_id", "case_id")
    return assess.revisions(e).select("case_id", F.sha2(F.array_join("revisions", ","), 256).alias("revisions_hash"), F.size("revisions").alias("n"))


def _raw(spark, d, kind: str) -> DataFrame:
    return read(spark, d, "documents", "doc_id", "source_type", "available_at").filter(F.col("source_type") == kind).select(F.col("doc_id").alias("id"), F.col("available_at").alias("updated_at"))


def ref_s2_issues(spark, d):
    """The hundred issues updated last since the spring."""
    return landed.list_issues(_raw(spark, d, "issue"), 100, F.to_timestamp(F.lit("2024-04-01"))).select("id")


def ref_s4_pull_requests(spark, d):
    return landed.list_pull_requests(_raw(spark, d, "pull_request"), 100, F.to_timestamp(F.lit("2024-04-01"))).select("id")


def ref_s5_children(spark, d):
    """At most two reviews or comments of each post, the first ones."""
    v = read(spark, d, "documents", "doc_id", "parent_source_entity_id", "occurred_at").filter("parent_source_entity_id is not null")
    return landed.list_children(v, "parent_source_entity_id", 2, ["occurred_at", "doc_id"]).select("doc_id")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("ref_") and k != "ref_q8_catalogue"}

_T = f"timestamptz '{CUTOFF}+00'"
_TRIM = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
_ISO = "strftime({} at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def _joined(*parts: str) -> str:
    return "concat_ws(chr(10) || chr(10), " + ", ".join(f"nullif({_TRIM.format(p)}, '')" for p in parts) + ")"


def _post(kind: str, title: str, *parts: str) -> str:
    author = "'Author: ' || nullif(source, '')"
    sections = [p if p != "author" else author for p in parts]
    at = "coalesce(available_at, occurred_at)"
    return f"select repository_id, '{kind}' as source_type, source_entity_id, 'provider:code%20host:{kind}:' || doc_id || '%2Fa%20b' as source_reference, {_ISO.format(at)} as source_version, {title} as title, {_joined(*sections)} as text from documents where source_type = '{kind}'"


_NO = "(doc_id % 1000)::varchar"
_STATE = "'State: ' || case when doc_id % 2 = 0 then 'open' else 'closed' end"
_NAMED = "coalesce(': ' || nullif(title, ''), '')"
_POSTS = " union all ".join(
    [
        _post("issue", "title", f"'Issue #' || {_NO} || {_NAMED}", _STATE, "author", "text"),
        _post("issue_comment", f"'Comment on issue #' || {_NO}", f"'Comment on issue #' || {_NO}", "author", "text"),
        _post("pull_request", "title", f"'Pull request #' || {_NO} || {_NAMED}", _STATE, "'Branches: work -> main'", "author", "text"),
        _post("review", f"'Review on pull request #' || {_NO}", f"'Review on pull request #' || {_NO}", _STATE, "author", "text"),
    ]
)
_C = "(select * from (select *, row_number() over (partition by repository_id, sha order by id) as rn from commits) where rn = 1)"


def _identity(*parts: str) -> str:
    return "sha256(" + " || ".join(f"length({p})::varchar || ':' || {p}" for p in parts) + ")"


_ID = _identity("'document_v1'", "repository_id", "source_type", "source_entity_id", "source_version")
_SOURCES = f"(select * from (select *, row_number() over (partition by repository_id, path order by available_at desc, id) as rn from documents where source_type = 'source_code' and path is not null and available_at <= {_T} and (superseded_at is null or superseded_at > {_T})) where rn = 1)"
_STALE = f"""e as (select *, row_number() over (partition by repository_id, chunk_id order by embedded_at desc, model desc, content_hash desc) as rn from chunk_embeddings),
st as (select c.repository_id, c.id as chunk_id, c.content from (select distinct id, repository_id, content, content_hash from document_chunks) c left join (select * from e where rn = 1) e on e.chunk_id = c.id and e.repository_id = c.repository_id
  where not (e.provider is not distinct from '{PROVIDER}' and e.model is not distinct from '{{model}}' and e.dimensions is not distinct from {{dims}} and e.content_hash is not distinct from c.content_hash))"""
_MODEL = "quartz-embed-512"
_KEY = "repository_id, source_type, source_entity_id, source_version"
_RESOLVED = rf"""s as (select id, repository_id, path, text from {_SOURCES}),
      b as (select distinct id, repository_id, kind, regexp_replace(path, '[^/]*$', '') as dir, unnest(regexp_extract_all(text, '(?m)^\s*' || word || '\b[^;"'']*?\bfrom\s*["''](\.[^"'']*)["'']', 1)) as spec from s, (values ('import', 'imports'), ('export', 'reexports')) w(word, kind) where regexp_matches(path, '\.(?:[cm]?[jt]s|[jt]sx)$')),
      p0 as (select *, regexp_replace(regexp_replace('/' || dir || spec, '/(\./)+', '/', 'g'), '/+', '/', 'g') as p from b),
      p1 as (select *, regexp_replace(p, '/[^/]+/\.\.(/|$)', '/') as q from p0), p2 as (select *, regexp_replace(q, '/[^/]+/\.\.(/|$)', '/') as r from p1), p3 as (select *, regexp_replace(r, '/[^/]+/\.\.(/|$)', '/') as t from p2),
      c as (select id, repository_id, spec, kind, ltrim(t, '/') || e as path, k from p3, (values ('', 0), ('.ts', 1), ('.tsx', 2), ('.d.ts', 3), ('.js', 4), ('.jsx', 5), ('.mjs', 6), ('.cjs', 7), ('/index.ts', 8), ('/index.tsx', 9), ('/index.js', 10), ('/index.jsx', 11)) v(e, k)),
      r as (select * from (select c.*, row_number() over (partition by id, spec, kind order by k) as rn from c join (select distinct repository_id, path from s) f using (repository_id, path)) where rn = 1)"""
SQL = {
    "ref_g1_documents": f"select source_type, source_entity_id, source_reference, source_version, coalesce(title, '') as title, sha256(text) as text_hash from ({_POSTS})",
    "ref_n1_commit_documents": f"select id as source_entity_id, 'git:' || sha as source_reference, coalesce(nullif({_TRIM.format('split_part(message, chr(10), 1)')}, ''), sha) as title, sha256({_joined(chr(39) + 'Commit ' + chr(39) + ' || sha', chr(39) + 'Author: ' + chr(39) + ' || author', 'message')}) as text_hash, epoch_us(committed_at) as available_us from {_C}",
    "ref_u2_union": f"select source_type, count(*) as documents, count(distinct id) as ids, min(id) as first_id from (select source_type, {_ID} as id from (select repository_id, source_type, source_entity_id, source_version from ({_POSTS}) union all select repository_id, 'commit', id, sha from {_C})) group by 1",
    "ref_k10_persisted": f"""with v as (select *, row_number() over (partition by {_KEY} order by (indexed_at >= {_T})::int desc, available_at desc, content_hash, superseded_at desc nulls first) as rn from documents), k as (select * from v where rn = 1)
      select repository_id, source_type, source_entity_id, source_version, epoch_us(available_at) as available_us, coalesce(epoch_us(least(coalesce(superseded_at, n), coalesce(n, superseded_at))), -1) as ended_us
      from (select k.*, (select min(x.available_at) from k x where x.repository_id = k.repository_id and x.source_type = k.source_type and x.source_entity_id = k.source_entity_id and x.available_at > k.available_at) as n from k)""",
    "ref_k10_intervals": "select c.id, epoch_us(d.available_at) as from_us, coalesce(epoch_us(d.superseded_at), -1) as to_us from (select distinct id, document_id from document_chunks) c join (select *, row_number() over (partition by id order by available_at desc, superseded_at desc nulls first) as rn from documents) d on d.id = c.document_id and d.rn = 1",
    "ref_k10_replaced_chunks": f"""with late as (select distinct id from documents where indexed_at >= {_T})
      select distinct id, document_id, chunk_index from document_chunks where document_id in (select id from documents) and document_id not in (select id from late) union all select 'new:' || id, id, 0 from late""",
    "ref_k11_relationships": """with n as (select distinct id, repository_id from source_relationships where available_at >= timestamptz '2024-10-01 00:00:00+00')
      select id, repository_id from n union all select id, repository_id from (select distinct id, repository_id from source_relationships) where repository_id not in (select repository_id from n)""",
    "ref_k12_reconciled": """with f as (select distinct repository_id, path from repository_files where path < 'p'),
      s as (select distinct id, repository_id from documents d where source_type = 'source_code' and not exists (select 1 from f where f.repository_id = d.repository_id and f.path = d.path))
      select s.repository_id, count(distinct s.id) as documents, count(distinct c.id) as chunks, count(e.chunk_id) as embeddings from s left join (select distinct id, document_id from document_chunks) c on c.document_id = s.id left join chunk_embeddings e on e.chunk_id = c.id group by 1""",
    "ref_k9_marked": f"select id, coalesce(epoch_us(case when id in (select repository_id from documents) then {_T} else indexed_at end), -1) as indexed_us from repositories",
    "ref_j2_parents": "select v.repository_id, v.source_type, count(*) as n from documents v where exists (select 1 from documents p where p.repository_id = v.repository_id and p.source_type = v.parent_source_type and p.source_entity_id = v.parent_source_entity_id) group by 1, 2",
    "ref_k3_orphans": "select doc_id from documents v where parent_source_entity_id is not null and not exists (select 1 from documents p where p.source_type = 'issue' and p.repository_id = v.repository_id and p.source_entity_id = v.parent_source_entity_id)",
    "ref_j9_resolution": f"with {_RESOLVED} select distinct id as document_id, spec as specifier, path from r",
    "ref_g8_edges": f"with {_RESOLVED} select distinct r.id as source_document_id, y.id as target_document_id, r.kind as relationship_type, x.path as source_path, r.path as target_path from r join s x on x.id = r.id join s y on y.repository_id = r.repository_id and y.path = r.path",
    "ref_a22_batches": f"with {_STALE.format(model=_MODEL, dims=DIMENSIONS)}, n as (select repository_id, length(content) as n, ((row_number() over (partition by repository_id order by length(content), chunk_id) - 1) // 64)::int as batch from st) select repository_id, batch, min(n) as shortest, max(n) as longest, sum(n)::bigint as characters from n group by 1, 2",
    "ref_q13_embedded": f"""with {_STALE.format(model=_MODEL, dims=64)}, w as (select repository_id, chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) as w from st),
      b as (select repository_id, chunk_id, ('0x' || substr(sha256(w), 1, 8))::bigint % 64 as k, sum(case when ('0x' || substr(sha256(w), 9, 2))::int % 2 = 0 then 1 else -1 end) as v from w group by 1, 2, 3),
      n as (select repository_id, chunk_id, sum(v * v) as s from b group by 1, 2) select st.repository_id, st.chunk_id, case when coalesce(n.s, 0) > 0 then 1.0 else 0.0 end::double as length from st left join n using (repository_id, chunk_id)""",
    "ref_t6_catalogue": "select id as repository_id, row_number() over (order by provider, owner, name, id)::int as place from repositories where deleted_at is null",
    "ref_u5_revisions": "select repository_id as case_id, sha256(string_agg(commit_sha, ',' order by commit_sha)) as revisions_hash, count(*)::int as n from (select distinct repository_id, commit_sha from documents where commit_sha is not null) group by 1",
    "ref_s2_issues": "select doc_id as id from documents where source_type = 'issue' and available_at >= timestamptz '2024-04-01 00:00:00+00' order by available_at desc, doc_id limit 100",
    "ref_s4_pull_requests": "select doc_id as id from documents where source_type = 'pull_request' and available_at >= timestamptz '2024-04-01 00:00:00+00' order by available_at desc, doc_id limit 100",
    "ref_s5_children": "select doc_id from (select doc_id, row_number() over (partition by parent_source_entity_id order by occurred_at, doc_id) as rn from documents where parent_source_entity_id is not null) where rn <= 2",
}
