"""Retrieval queries: the three scans, fusion, file evidence, expansion, priors, reserve and packs, for all live repositories at once."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intents as it
from ..functions import roles as ro
from ..functions import stem as st
from ..functions import vectors as vx
from ..operators import assess, graph, pack, ranking, requests, search
from ..operators.upsert import newest
from ..runtime import Scratch
from ..sources.tables import read
from . import catalog
from .catalog import CUTOFF, DIMENSIONS, MODEL, cutoff

#: What is asked of every repository.
ASKED = [("errors", "how does the retry queue handle errors"), ("settings", "where is the session token configuration"), ("tests", "tests for the cache scheduler"), ("symbol", "retryQueue")]
BRANCHES = ["dense", "lexical", "structured"]
FUSED = [*BRANCHES, "file", "relationship"]
_CHUNK = ["id", "document_id", "repository_id", "source_type", "source_reference", "chunk_index", "content", "language", "symbol_id", "symbol_name", "symbol_kind", "parent_symbol", "symbol_part", "start_line", "end_line", "available_at", "superseded_at", "path", "indexed_at"]
_EDGES = ["id", "repository_id", "source_document_id", "target_document_id", "relationship_type", "source_path", "target_path", "target_symbol", "resolution", "available_at", "superseded_at"]


def questions(spark, d) -> DataFrame:
    """Each live repository with each question and its embedding."""
    r = read(spark, d, "repositories", "id", "deleted_at").filter("deleted_at is null")
    asked = spark.createDataFrame([(k, t, [float(x) for x in vx.hash_embedding(t, DIMENSIONS)]) for k, t in ASKED], "k string, query string, vector array<float>")
    q = r.select(F.col("id").alias("repository_id"), F.explode(F.array(*[F.lit(k) for k, _ in ASKED])).alias("k")).join(F.broadcast(asked), "k")
    return q.select(F.concat("repository_id", F.lit(":"), "k").alias("query_id"), "repository_id", "query", cutoff().alias("cutoff"), "vector")


def rows(spark, d) -> DataFrame:
    """The chunk table as it is, repeats and all."""
    return read(spark, d, "document_chunks", *_CHUNK).withColumnRenamed("id", "chunk_id")


def chunks(spark, d) -> DataFrame:
    """One row a chunk."""
    return search.latest_chunks(read(spark, d, "document_chunks", *_CHUNK))


def embeddings(spark, d) -> DataFrame:
    """The newest usable vector of each chunk."""
    e = read(spark, d, "chunk_embeddings", "chunk_id", "repository_id", "model", "dimensions", "embedding", "embedded_at").filter((F.col("model") == MODEL) & (F.col("dimensions") == DIMENSIONS) & vx.is_usable(F.col("embedding"), DIMENSIONS))
    return newest(e, ["repository_id", "chunk_id"], "embedded_at")


def probes(spark, d) -> DataFrame:
    """Each probe chunk as a query by its own vector, in its own repository."""
    p = read(spark, d, "probe_chunks", "chunk_id", "repository_id").distinct()
    e = embeddings(spark, d).select("chunk_id", "repository_id", F.col("embedding").alias("vector"))
    return p.join(e, ["chunk_id", "repository_id"]).select(F.col("chunk_id").alias("query_id"), "repository_id", cutoff().alias("cutoff"), "vector")


def ref_q1_dense(spark, d):
    r = search.nearest(probes(spark, d), rows(spark, d), embeddings(spark, d), 10)
    return r.select("query_id", "chunk_id", vx.rounded(F.col("score"), 6).alias("score"), "rank")


def ref_q2_lexical(spark, d):
    return search.lexical(questions(spark, d), rows(spark, d)).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def ref_q3_structured(spark, d):
    return search.structured(questions(spark, d), rows(spark, d)).select("query_id", "chunk_id", "exact", F.round("score", 4).alias("score"), "rank")


def _lists(spark, d, asked: DataFrame | None = None) -> DataFrame:
    """The three branches of every question: rank as found, place after thinning by path (null for what was thinned out).

    The lists are slim and every later step reads them, some twice: they are kept as a table, so the scans run once.
    """
    q, c, e = (questions(spark, d) if asked is None else asked), rows(spark, d), embeddings(spark, d)
    found = [("dense", search.dense(q, c, e)), ("lexical", search.lexical(q, c)), ("structured", search.structured(q, c))]
    scratch = Scratch(spark, "lists")
    raw = scratch.keep(_union([r.withColumn("branch", F.lit(name)) for name, r in found]))
    thin = ranking.diversify(raw, ranking.BRANCH_LIMIT, ranking.PER_PATH, ["query_id", "branch"])
    place = ranking.rank_by(thin, ["query_id", "branch"], [F.col("rank")], "place").select("query_id", "branch", "chunk_id", "place")
    return scratch.keep(raw.join(place, ["query_id", "branch", "chunk_id"], "left"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def ref_w2_diversified(spark, d):
    r = search.structured(questions(spark, d), rows(spark, d))
    return ranking.diversify(r, 20, 2, ["query_id"]).select("query_id", "chunk_id", "rank")


def _representatives(spark, d, lists: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    f = ranking.file_evidence(lists, "multi-branch", BRANCHES)
    r = ranking.representatives(lists, f, (questions(spark, d) if asked is None else asked))
    return r.join(f.select("query_id", "path", "sources"), ["query_id", "path"])


def _fused(lists: DataFrame, reps: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Fusion of the branches and what is known of each candidate; as long as the branches and the relationships together."""
    ranked = [lists.filter("place is not null").select("query_id", "branch", "chunk_id", F.col("place").alias("rank")), reps.select("query_id", F.lit("file").alias("branch"), "chunk_id", F.col("file_rank").alias("rank"))]
    room = ranked[0].select("query_id")
    if related is not None:
        ranked.append(related.select("query_id", F.lit("relationship").alias("branch"), "chunk_id", F.col("relationship_rank").alias("rank")))
        room = room.unionByName(related.select("query_id"))
    room = room.groupBy("query_id").agg(F.count("*").alias("room"))
    f = ranking.fuse(_union(ranked), FUSED).join(room, "query_id").filter("rrf_rank <= room").drop("room")
    # a representative brings the ranks that its branches gave it, thinned out or not
    mine = reps.select("query_id", "chunk_id", "file_rank", F.col("sources").alias("file_sources"))
    known = lists.join(mine, ["query_id", "chunk_id"], "left").filter("place is not null or file_rank is not null")
    about = known.groupBy("query_id", "chunk_id").agg(F.max("exact").alias("exact"), F.countDistinct("branch").alias("branches"), F.max("file_rank").alias("file_rank_"), F.max("file_sources").alias("file_sources"), *[F.max(c).alias(c) for c in ("path", "symbol_name", "symbol_kind", "source_type", "document_id")])
    about = about.withColumn("direct", F.lit(True))
    if related is not None:
        extra = related.select("query_id", "chunk_id", "path", "symbol_name", "symbol_kind", "source_type", "document_id", F.lit(False).alias("exact"), F.lit(0).cast("bigint").alias("branches"))
        about = _union([about, extra.join(about.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")])
        direct = lists.select("query_id", "chunk_id").distinct().withColumn("found", F.lit(True))
        about = about.join(direct, ["query_id", "chunk_id"], "left").withColumn("direct", F.coalesce("found", F.lit(False))).drop("found")
    return f.join(about, ["query_id", "chunk_id"])


def ref_a4_fused(spark, d):
    """The three scans and the file evidence, fused."""
    lists = _lists(spark, d)
    f = _fused(lists, _representatives(spark, d, lists)).filter(F.col("rrf_rank") <= ranking.POOL)
    return f.select("query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), *[F.coalesce(f"{b}_rank", F.lit(-1)).alias(f"{b}_rank") for b in FUSED[:4]], "rrf_rank")


def ref_a5_file_evidence(spark, d):
    lists = _lists(spark, d)
    out = None
    for s in ("max", "multi-branch", "bounded"):
        f = ranking.file_evidence(lists, s, BRANCHES).select(F.lit(s).alias("strategy"), "query_id", "path", F.round("score", 9).alias("score"), "best_rank", "sources", "file_rank")
        out = f if out is None else out.union(f)
    return out


def ref_w4_representatives(spark, d):
    lists = _lists(spark, d)
    return _representatives(spark, d, lists).select("query_id", "path", "chunk_id", "file_rank", "representative", "reason")


def _expanded(spark, d, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lists, representatives, related): everything the last fusion takes; the relationships start from a first fusion without them."""
    scratch = Scratch(spark, "expanded")
    lists = _lists(spark, d, asked)
    reps = scratch.keep(_representatives(spark, d, lists, asked))
    q = (questions(spark, d) if asked is None else asked).drop("vector")
    a = scratch.keep(graph.anchors(_fused(lists, reps).drop("file_rank").withColumnRenamed("file_rank_", "file_rank")).join(q.select("query_id", "repository_id", "cutoff"), "query_id"))
    return lists, reps, scratch.keep(graph.expand(a, read(spark, d, "source_relationships", *_EDGES), chunks(spark, d), q))


def ref_w6_anchors(spark, d):
    lists = _lists(spark, d)
    a = graph.anchors(_fused(lists, _representatives(spark, d, lists)).drop("file_rank").withColumnRenamed("file_rank_", "file_rank"))
    return a.select("query_id", "document_id", "chunk_id", "strength", "anchor")


def ref_j4_expansion(spark, d):
    return _expanded(spark, d)[2].select("query_id", "chunk_id", "type", "relationship_rank")


def _ranked(spark, d, strategy: str = "weak", asked: DataFrame | None = None) -> DataFrame:
    """All candidates of the five branches, re-ranked by how well roles suit the question. Kept: the pool and the reserve both read it."""
    lists, reps, related = _expanded(spark, d, asked)
    f = _fused(lists, reps, related).join((questions(spark, d) if asked is None else asked).select("query_id", it.signals(F.col("query")).alias("signals")), "query_id")
    f = f.withColumn("role", ro.classify(F.col("source_type"), F.col("path"), F.col("symbol_kind"))["role"])
    f = f.withColumn("compatibility", ro.compatibility(F.col("signals"), F.col("role"), F.col("exact"), F.col("symbol_name")))
    return Scratch(spark, "pool").keep(ranking.role_prior(f, strategy))


def ref_w10_prior(spark, d):
    """The head of the re-ranked candidates."""
    return _ranked(spark, d).filter("final_rank <= 100").select("query_id", "chunk_id", "role", F.round("compatibility", 4).alias("compatibility"), F.coalesce("role_rank", F.lit(-1)).alias("role_rank"), F.round("score", 9).alias("score"), "final_rank")


def _pool(spark, d, strategy: str = "weak", asked: DataFrame | None = None) -> DataFrame:
    ranked = _ranked(spark, d, strategy, asked)
    slim = ranked.select("query_id", "chunk_id", "path", "exact", F.col("final_rank").alias("rrf_rank"), F.when(~F.col("direct"), F.col("relationship_rank")).alias("relationship_rank"))
    pool = ranking.diversify(slim, ranking.POOL, ranking.PER_PATH, ["query_id"], rank="rrf_rank")
    kept = graph.reserve(pool, slim.filter("relationship_rank is not null"), ranking.PER_PATH, graph.RESERVE, ranking.POOL)
    return Scratch(spark, "reserved").keep(ranked.join(kept, ["query_id", "chunk_id"]))


def ref_q4_hybrid(spark, d):
    """Hybrid search: three scans thinned and fused with file evidence and relationships, the prior of roles, the pool and its reserve."""
    return _pool(spark, d).select("query_id", "chunk_id", "role", F.round("compatibility", 4).alias("compatibility"), F.coalesce("role_rank", F.lit(-1)).alias("role_rank"), F.round("score", 9).alias("score"), "pool_rank")


def ref_w11_reserved(spark, d):
    """What the reserve put into the pool: candidates that only a relationship brought."""
    return _pool(spark, d).filter("not direct").select("query_id", "chunk_id", "relationship_rank", "pool_rank")


def _candidates(spark, d, asked: DataFrame | None = None) -> DataFrame:
    """What packs are made of: the pool's head, the anchors' own context and their relationships."""
    c = Scratch(spark, "chunks").keep(chunks(spark, d))
    pool = _pool(spark, d, asked=asked)
    q = (questions(spark, d) if asked is None else asked).drop("vector")
    top = ranking.rank_by(pool.select("query_id", "chunk_id", "exact", "pool_rank", "role"), ["query_id"], [F.col("pool_rank")], "rank", 15).withColumn("origin", F.lit("primary"))
    picked = Scratch(spark, "picked").keep(pack.chosen(top.join(c, "chunk_id"), _intents(spark, d, asked)))
    anchors = picked.join(c.select("chunk_id", "document_id", "chunk_index", "symbol_id", "symbol_name", "parent_symbol"), "chunk_id")
    near = graph.local_context(anchors, c)
    near = near.select("query_id", "chunk_id", F.lit(False).alias("exact"), F.col("place").alias("rank"), F.lit("local").alias("origin"), "reason", "priority")
    near = ranking.first_of(near, ["query_id", "chunk_id"], [F.col("priority"), F.col("rank")])
    a = ranking.first_of(anchors.select("query_id", "document_id", "anchor"), ["query_id", "document_id"], [F.col("anchor")]).join(q.select("query_id", "repository_id", "cutoff"), "query_id")
    rel = graph.expand(a, read(spark, d, "source_relationships", *_EDGES), c, q, pack.PER_ANCHOR, pack.PER_ANCHOR * pack.ANCHORS)
    rel = rel.select("query_id", "chunk_id", F.lit(False).alias("exact"), F.col("relationship_rank").alias("rank"), F.lit("relation").alias("origin"), F.col("type").alias("relation"))
    cand = _union([top.drop("pool_rank", "role"), near, rel]).join(c, "chunk_id")
    return cand.withColumn("role", ro.classify(F.col("source_type"), F.col("path"), F.col("symbol_kind"))["role"])


def _intents(spark, d, asked: DataFrame | None = None) -> DataFrame:
    return (questions(spark, d) if asked is None else asked).select("query_id", F.transform(it.signals(F.col("query")), lambda s: s["intent"]).alias("intents"))


def ref_q7_packs(spark, d):
    """Evidence packs of 30,000 characters for every question."""
    return pack.build(_candidates(spark, d), _intents(spark, d)).drop("content")


def ref_f6_decisions(spark, d):
    """What packing decided, and how often, by question and action."""
    return pack.decisions(_candidates(spark, d), _intents(spark, d)).groupBy("query_id", "action").agg(F.count("*").alias("n"))


def agent_context(spark, d, repository_id: str, query: str, characters: int = 30_000, at=None) -> DataFrame:
    """The pack of one request, checked before and after: rows of pack.build, or a RequestError that says why not.

    The request is validated, the repository must be ready, and no item may be of another repository or of later
    than the cutoff.
    """
    r = requests.normalised(repository_id, query, cutoff=at)
    requests.budget(characters)
    deleted = read(spark, d, "repositories", "id", "deleted_at").withColumnRenamed("id", "repository_id")
    requests.ready(deleted.join(catalog.ref_q8_catalogue(spark, d), "repository_id", "left"), r.repository_id)
    vector = [float(x) for x in vx.hash_embedding(r.query, DIMENSIONS)]
    asked = spark.createDataFrame([("request", r.repository_id, r.query, r.cutoff, vector)], "query_id string, repository_id string, query string, cutoff timestamp, vector array<float>")
    items = Scratch(spark, "request").keep(pack.build(_candidates(spark, d, asked), _intents(spark, d, asked), characters))
    where = chunks(spark, d).select("chunk_id", "repository_id", "available_at").join(items.select("chunk_id"), "chunk_id", "left_semi")
    case = asked.select(F.col("query_id").alias("case_id"), "repository_id", "cutoff")
    safe = assess.isolated(where.withColumn("case_id", F.lit("request")), case).select("chunk_id")
    return items.join(safe, "chunk_id", "left_semi")


def ref_q9_contexts(spark, d):
    """The context of one request to the first repository that is ready: its items without their texts."""
    first = catalog.ref_q8_catalogue(spark, d).filter("ready").agg(F.min("repository_id")).first()[0]
    return agent_context(spark, d, first, ASKED[0][1], 30_000, datetime.fromisoformat(CUTOFF)).drop("content")


def ref_p1_results(spark, d):
    """The three best of each question as full results: fields, and the metadata of their source as one record."""
    r = search.lexical(questions(spark, d), rows(spark, d), 3)
    full = search.results(r, read(spark, d, "document_chunks"))
    return full.select("query_id", "rank", "chunk_id", "repository_id", "language", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"), F.col("source_metadata.document_id").alias("document_id"), F.col("source_metadata.source_reference").alias("source_reference"), F.col("source_metadata.chunk_index").alias("chunk_index"), F.unix_micros("available_at").alias("available_us"))


def ref_p13_safety(spark, d):
    """Items of packs that break isolation or time: of another repository than asked, or available after the cutoff. There are none."""
    items = pack.build(_candidates(spark, d), _intents(spark, d)).select("query_id", "chunk_id").join(chunks(spark, d).select("chunk_id", "repository_id", "available_at"), "chunk_id")
    q = questions(spark, d).select("query_id", F.col("repository_id").alias("asked"), "cutoff")
    return items.join(q, "query_id").select(F.count_if(F.col("repository_id") != F.col("asked")).alias("foreign_items"), F.count_if(F.col("available_at") > F.col("cutoff")).alias("future_items"))


def ref_f1_raw_top(spark, d):
    """The plain baseline: whole chunks in lexical order until 8,000 characters are used."""
    r = search.lexical(questions(spark, d), rows(spark, d)).join(chunks(spark, d).select("chunk_id", "content"), "chunk_id")
    return pack.raw_top(r, 8_000).select("query_id", "chunk_id", "rank", "kept")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("ref_")}

_T = f"timestamptz '{CUTOFF}+00'"


def _tok(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"


def _names(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[/._\-\s]+'), lambda x: x <> '')"


def _terms(query: str) -> list[str]:
    """The structural terms of a question, for its SQL."""
    import re

    from ..functions.text import STOP_WORDS

    q = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", query))
    first = [t for t in re.sub(r"[^A-Za-z0-9]+", " ", q).strip().lower().split(" ") if t and t not in STOP_WORDS]
    out = list(dict.fromkeys(first))
    for t in first:
        for ok, s in ((len(t) > 3 and t.endswith("s"), t[:-1]), (len(t) > 4 and t.endswith("ed") and not t.endswith("zed"), t[:-2]), (len(t) > 5 and t.endswith("ing"), t[:-3])):
            if ok and s not in out:
                out.append(s)
    return out


_VALUES = ", ".join(f"('{k}', '{t}', {_terms(t)}, {[float(x) for x in vx.hash_embedding(t, DIMENSIONS)]}::float[])" for k, t in ASKED)
_COLS = "id as chunk_id, document_id, repository_id, source_type, source_reference, content, language, symbol_id, symbol_name, symbol_kind, parent_symbol, available_at, superseded_at, path, chunk_index"
_STOP = ", ".join(f"'{w}'" for w in st.STOP_WORDS)
_BASE = f"""q as (select r.id || ':' || k as query_id, r.id as repository_id, k, query, terms, vector from repositories r, (values {_VALUES}) v(k, query, terms, vector) where r.deleted_at is null),
c as (select distinct {_COLS} from document_chunks where available_at <= {_T} and (superseded_at is null or superseded_at > {_T})),
pos as (select chunk_id, unnest(list_concat({_tok('path')}, {_tok('symbol_name')})) as word, 1.0 as wt, false as eng from c
  union all select chunk_id, unnest({_tok('content')}), 0.4, true from c union all select chunk_id, unnest({_tok('parent_symbol')}), 0.2, false from c
  union all select chunk_id, unnest(list_concat(list_concat({_tok('source_type')}, {_tok('source_reference')}), list_concat({_tok('language')}, {_tok('symbol_kind')}))), 0.1, false from c),
qword as (select distinct k, unnest({_tok('query')}) as word from q),
word0 as (select distinct word from (select word from pos where eng union all select word from qword) where word not in ({_STOP})),
{st.sql('word0')},
qlex as (select k, word as lexeme from qword union select k, stem from qword join stems using (word)),
plex as (select chunk_id, wt, word as lexeme from pos where not eng union all select chunk_id, wt, stem from pos join stems using (word) where eng),
hit as (select k, chunk_id, round(sum(wt), 6)::double as score from plex join qlex using (lexeme) group by 1, 2),
lex0 as (select q.query_id, c.chunk_id, c.path, false as exact, hit.score from q join hit using (k) join c on c.chunk_id = hit.chunk_id and c.repository_id = q.repository_id),
lex as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from lex0 where score > 0) where rank <= 300),
str0 as (select q.query_id, c.chunk_id, c.path, coalesce(c.symbol_name = q.query, false) as exact, round(
    1.0 * (len(list_filter({_names('c.symbol_name')}, lambda x: len(list_filter(q.terms, lambda w: starts_with(x, w))) > 0)) + len(list_filter({_names('c.path')}, lambda x: len(list_filter(q.terms, lambda w: starts_with(x, w))) > 0)))
  + 0.4 * len(list_filter({_names('c.parent_symbol')}, lambda x: len(list_filter(q.terms, lambda w: starts_with(x, w))) > 0)) + 0.1 * len(list_filter({_names('c.symbol_kind')}, lambda x: len(list_filter(q.terms, lambda w: starts_with(x, w))) > 0)), 6)::double as score
  from q join c using (repository_id) where len(q.terms) > 0),
str as (select * from (select *, row_number() over (partition by query_id order by exact desc, score desc, chunk_id)::int as rank from str0 where exact or score > 0) where rank <= 300),
e as (select * from (select *, row_number() over (partition by repository_id, chunk_id order by embedded_at desc) as rn from chunk_embeddings where model = '{MODEL}' and dimensions = {DIMENSIONS} and len(embedding) = {DIMENSIONS}
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0) where rn = 1),
pr as (select distinct p.chunk_id as query_id, p.repository_id, e.embedding as vector from probe_chunks p join e on e.chunk_id = p.chunk_id and e.repository_id = p.repository_id),
den1 as (select pr.query_id, pr.repository_id, c.chunk_id, c.path, round(list_cosine_similarity(e.embedding::double[], pr.vector::double[]), 9) as score from pr join c using (repository_id) join e on e.chunk_id = c.chunk_id and e.repository_id = c.repository_id),
denq as (select q.query_id, c.chunk_id, c.path, false as exact, round(list_cosine_similarity(e.embedding::double[], q.vector::double[]), 9) as score from q join c using (repository_id) join e on e.chunk_id = c.chunk_id and e.repository_id = c.repository_id),
den as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from denq) where rank <= 300)"""


def _w2(src: str, out: str, limit: int, cap: int, rank: str = "rank") -> str:
    """The closed form of diversification as common table expressions."""
    return f"""{out}_a as (select *, min(case when exact and path is not null then {rank} end) over (partition by query_id, path) as fx from {src}),
{out}_b as (select *, (exact and path is not null and {rank} = fx) as cand from {out}_a),
{out}_c as (select *, cand and sum(cand::int) over (partition by query_id order by {rank}) <= {limit} as prot from {out}_b),
{out}_d as (select *, max(prot::int) over (partition by query_id, path) as has, row_number() over (partition by query_id, path, prot order by {rank}) as kth from {out}_c),
{out}_e as (select *, not prot and (path is null or kth <= {cap} - has) as fits from {out}_d),
{out}_f as (select *, sum(prot::int) over (partition by query_id) as np, sum(fits::int) over (partition by query_id order by {rank}) as fn from {out}_e),
{out} as (select * from {out}_f where prot or (fits and fn <= {limit} - np))"""


def _symbols(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(coalesce({c}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 1))"


def _weight(c: str) -> str:
    return f"case when {c} in ('function', 'method', 'class') then 2 when {c} in ('variable', 'property') then 1 else 0 end"


def _place(name: str) -> str:
    return f"select '{name}' as branch, r.query_id, r.chunk_id, r.path, r.exact, r.rank, w.place from {name[:3]} r left join (select query_id, chunk_id, row_number() over (partition by query_id order by rank)::int as place from {name[:3]}w) w using (query_id, chunk_id)"


def _fusion(out: str, related: bool) -> str:
    """The fusion of the branches, with relationships or without."""
    ranks = "dense lexical structured file relationship".split()
    total = " + ".join(f"coalesce(1.0::double / (60 + {r}_rank), 0)" for r in ranks)
    extra = " union all select query_id, 'relationship', chunk_id, relationship_rank from rel" if related else ""
    more = " union all select query_id from rel" if related else ""
    return f"""{out}_r as (select query_id, branch, chunk_id, place as rank from lists where place is not null union all select query_id, 'file', chunk_id, file_rank from reps{extra}),
{out}_0 as (select query_id, chunk_id, min(rank) as best, {', '.join(f"min(case when branch = '{r}' then rank end) as {r}_rank" for r in ranks)} from {out}_r group by 1, 2),
{out}_1 as (select *, {total} as rrf_score from {out}_0),
{out}_n as (select query_id, count(*) as room from (select query_id from lists where place is not null{more}) group by 1),
{out} as (select * from (select *, row_number() over (partition by query_id order by rrf_score desc, best, chunk_id)::int as rrf_rank from {out}_1) join {out}_n using (query_id) where rrf_rank <= room)"""


_LISTS = f"""{_BASE}, {_w2('den', 'denw', 100, 2)}, {_w2('lex', 'lexw', 100, 2)}, {_w2('str', 'strw', 100, 2)},
lists as ({_place('dense')} union all {_place('lexical')} union all {_place('structured')})"""
_FILES = f"""{_LISTS},
fb as (select query_id, path, branch, min(rank) as r from lists where path is not null group by 1, 2, 3),
fs as (select query_id, path, round(sum(1.0::double / (60 + r)), 12) as score, min(r) as best_rank, count(*) as sources from fb group by 1, 2),
fr as (select * from (select *, row_number() over (partition by query_id order by score desc, best_rank, path)::int as file_rank from fs) where file_rank <= 50),
rp0 as (select l.query_id, l.path, fr.file_rank, fr.sources, l.chunk_id, max(l.exact::int) as exact, min(l.rank) as best_rank, count(distinct branch) as branches from lists l join fr using (query_id, path) group by 1, 2, 3, 4, 5),
rp1 as (select rp0.*, len(list_intersect({_symbols("concat_ws(' ', c.symbol_name, c.parent_symbol)")}, {_symbols('q.query')})) as overlap, {_weight('c.symbol_kind')} as impl from rp0 join q using (query_id) join c using (chunk_id)),
rp2 as (select *, row_number() over (partition by query_id, path order by exact desc, overlap desc, impl desc, branches desc, best_rank, chunk_id)::int as representative from rp1),
reps as (select *, case when exact = 1 then 'exact-symbol' when overlap > 0 then 'query-symbol-overlap' when impl > 0 then 'implementation-symbol' when branches > 1 then 'multi-branch-chunk' else 'best-direct-rank' end as reason from rp2 where representative <= 2),
kn as (select l.*, reps.file_rank, reps.sources from lists l left join reps using (query_id, chunk_id) where place is not null or reps.file_rank is not null),
about as (select query_id, chunk_id, bool_or(exact) as exact, count(distinct branch) as branches, max(file_rank) as file_rank_, max(sources) as file_sources from kn group by 1, 2),
{_fusion('fused', False)}"""
_RELATED = f"""{_FILES},
an0 as (select f.query_id, f.chunk_id, c.document_id, f.rrf_rank, least(f.rrf_rank, coalesce(a.file_rank_, 1000000)) as ev, case when a.exact then 0 when a.branches >= 2 then 1 when coalesce(a.file_sources, 0) >= 2 then 2 when f.rrf_rank <= 5 then 3 end as strength from fused f join about a using (query_id, chunk_id) join c using (chunk_id)),
an1 as (select *, row_number() over (partition by query_id, document_id order by strength, ev, rrf_rank, chunk_id) as rn from an0 where strength is not null),
an as (select * from (select *, row_number() over (partition by query_id order by strength, ev, rrf_rank, chunk_id)::int as anchor from an1 where rn = 1) where anchor <= 12),
rr as (select distinct {', '.join(_EDGES)} from source_relationships where available_at <= {_T} and (superseded_at is null or superseded_at > {_T})),
ed as (select an.query_id, anchor, rr.id as edge_id, relationship_type as type, target_document_id as neighbour, source_path, target_path, resolution, target_symbol from an join q using (query_id) join rr on rr.source_document_id = an.document_id and rr.repository_id = q.repository_id
  union all select an.query_id, anchor, rr.id, 'imported_by', source_document_id, source_path, target_path, 'module', null from an join q using (query_id) join rr on rr.target_document_id = an.document_id and rr.repository_id = q.repository_id and relationship_type = 'imports'),
ed1 as (select ed.*, case type when 'imports' then 0 when 'reexports' then 1 else 2 end as kind, len(list_intersect({_symbols("concat_ws(' ', target_symbol, case when type = 'imported_by' then source_path else target_path end)")}, {_symbols('q.query')})) as overlap from ed join q using (query_id) where not exists (select 1 from an where an.query_id = ed.query_id and an.document_id = ed.neighbour)),
ed2 as (select *, row_number() over (partition by query_id, anchor, neighbour order by kind, (resolution <> 'exact_symbol')::int, overlap desc, (target_symbol is null)::int, source_path, target_path, edge_id) as rn from ed1),
ed3 as (select *, row_number() over (partition by query_id, anchor order by kind, (resolution <> 'exact_symbol')::int, overlap desc, (target_symbol is null)::int, source_path, target_path, edge_id) as turn from ed2 where rn = 1),
ed4 as (select *, row_number() over (partition by query_id, neighbour order by turn, anchor) as rn2 from ed3 where turn <= 3),
ed5 as (select * from (select *, row_number() over (partition by query_id order by turn, anchor)::int as relationship_rank from ed4 where rn2 = 1) where relationship_rank <= 16),
nb as (select ed5.query_id, ed5.relationship_rank, ed5.type, c.chunk_id, c.path, row_number() over (partition by ed5.query_id, ed5.neighbour order by (not coalesce(c.symbol_name = ed5.target_symbol, false))::int, len(list_intersect({_symbols("concat_ws(' ', c.symbol_name, c.parent_symbol)")}, {_symbols('q.query')})) desc, {_weight('c.symbol_kind')} desc, coalesce(c.symbol_kind = 'module', false)::int, c.chunk_index, c.chunk_id) as rn3 from ed5 join q using (query_id) join c on c.document_id = ed5.neighbour and c.repository_id = q.repository_id),
rel as (select * from nb where rn3 = 1)"""


def _signals(query: str) -> dict[str, float]:
    """The intents of a question, for its SQL."""
    out: dict[str, float] = {}
    for intent, confidence, _, case, words in it.RULES:
        if re.search(rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])", query, 0 if case else re.I):
            out[intent] = max(out.get(intent, 0.0), confidence)
    if any(re.search(p, query) for p in (it.FILE_SHAPE, it.PATH_SHAPE)) or re.search(it.IDENTIFIER_SHAPE, query) and re.search(it.IDENTIFIER_MARK, query):
        out["exact_symbol"] = 1.0
    return out


def _role(path: str, source_type: str, symbol_kind: str) -> str:
    """The role of a source, as SQL."""
    p = rf"lower(regexp_replace(replace({path}, '\', '/'), '^\./', ''))"

    def test(x) -> str:
        return "(" + " and ".join(map(test, x)) + ")" if isinstance(x, list) else f"regexp_matches({p}, '{x}')"

    whens = " ".join(f"when {' or '.join(map(test, patterns))} then '{role}'" for role, _, patterns in ro.RULES)
    return f"""case when {source_type} is distinct from 'source_code' then 'development_history' when {path} is null or {path} = '' then 'unknown' {whens}
      when {p} like '%.d.ts' or coalesce({symbol_kind} in ('interface', 'type', 'enum'), false) then 'type_definition' when regexp_matches({p}, '{ro._ending(ro.PRODUCTION)}') or {symbol_kind} is not null then 'production_implementation' else 'unknown' end"""


_CELLS = ", ".join(f"('{k}', '{role}', {max(ro.COMPATIBILITY.get(i, {}).get(role, 0) * c for i, c in _signals(t).items()) if _signals(t) else 0.0}::double)" for k, t in ASKED for role in ro.ROLES)
_EXACT = ", ".join(f"('{k}', {_signals(t).get('exact_symbol', 0.0)}::double)" for k, t in ASKED)
_PRIOR = f"""{_RELATED}, {_fusion('again', True)},
cell(k, role, s) as (values {_CELLS}), ex(k, xc) as (values {_EXACT}),
ro0 as (select g.query_id, g.chunk_id, g.rrf_score, g.rrf_rank, q.k, c.symbol_name, c.path, coalesce(a.exact, false) as exact, {_role('c.path', 'c.source_type', 'c.symbol_kind')} as role from again g join q using (query_id) join c using (chunk_id) left join about a on a.query_id = g.query_id and a.chunk_id = g.chunk_id),
ro1 as (select ro0.*, greatest(coalesce(cell.s, 0), xc * case when exact then 1.0 when symbol_name is not null then 0.55 else 0.0 end) as compatibility from ro0 join ex using (k) left join cell on cell.k = ro0.k and cell.role = ro0.role),
ro2 as (select *, case when compatibility >= 0.75 then row_number() over (partition by query_id, compatibility >= 0.75 order by rrf_rank, chunk_id)::int end as role_rank from ro1),
ro3 as (select *, rrf_score + coalesce(0.2::double / (60 + role_rank), 0) as score from ro2),
prior as (select *, row_number() over (partition by query_id order by score desc, rrf_rank, chunk_id)::int as final_rank from ro3)"""
_EVIDENCE = f"""with {_LISTS}, one as (select * from lists where path is not null),
ab as (select query_id, path, min(rank) as best_rank, count(distinct branch) as sources from one group by 1, 2),
ch as (select query_id, path, chunk_id, sum(1.0::double / (60 + rank)) as s from one group by 1, 2, 3),
br as (select query_id, path, branch, min(rank) as r from one group by 1, 2, 3),
tp as (select *, row_number() over (partition by query_id, path order by s desc, chunk_id) as i from ch),
sc as (select 'max' as strategy, query_id, path, max(s) as score from ch group by 2, 3 union all select 'multi-branch', query_id, path, sum(1.0::double / (60 + r)) from br group by 2, 3 union all select 'bounded', query_id, path, sum(s / i) from tp where i <= 2 group by 2, 3),
rk as (select sc.strategy, sc.query_id, sc.path, round(sc.score, 12) as score, ab.best_rank, ab.sources, row_number() over (partition by sc.strategy, sc.query_id order by round(sc.score, 12) desc, ab.best_rank, sc.path)::int as file_rank from sc join ab using (query_id, path))
select strategy, query_id, path, round(score, 9) as score, best_rank, sources, file_rank from rk where file_rank <= 50"""
def _reserve() -> str:
    """The pool and its reserve, step by step: as common table expressions that end in `pool`(query_id, pos, chunk_id)."""
    out = f"""slim as (select p.query_id, p.chunk_id, p.path, p.exact, p.final_rank as rank, case when d.chunk_id is null then p.relationship_rank end as relationship_rank from (select pr.*, again.relationship_rank from prior pr join again using (query_id, chunk_id)) p left join (select distinct query_id, chunk_id from lists) d on d.query_id = p.query_id and d.chunk_id = p.chunk_id),
{_w2('slim', 'slimw', 50, 2)},
want as (select * from (select *, row_number() over (partition by query_id order by relationship_rank, rank, chunk_id) as step from slim where relationship_rank is not null) where step <= 4),
sel0 as (select query_id, chunk_id, path, exact, rank, row_number() over (partition by query_id order by rank) as pos, count(*) over (partition by query_id) as n from slimw)"""
    for i in range(1, 5):
        old = f"sel{i - 1}"
        out += f""",
put{i} as (select w.query_id, w.chunk_id, w.path, w.exact, w.rank, max(s.pos) as pos from want w join {old} s using (query_id) where w.step = {i} and s.n >= 50 and not exists (select 1 from {old} x where x.query_id = w.query_id and x.chunk_id = w.chunk_id)
  and not coalesce(s.exact, false) and not exists (select 1 from want k where k.query_id = w.query_id and k.chunk_id = s.chunk_id)
  and (w.path is null or (select count(*) from {old} y where y.query_id = w.query_id and y.path = w.path) < 2 or coalesce(s.path = w.path, false)) group by 1, 2, 3, 4, 5),
sel{i} as (select s.query_id, coalesce(p.chunk_id, s.chunk_id) as chunk_id, case when p.chunk_id is null then s.path else p.path end as path, case when p.chunk_id is null then s.exact else p.exact end as exact, coalesce(p.rank, s.rank) as rank, s.pos, s.n from {old} s left join put{i} p on p.query_id = s.query_id and p.pos = s.pos)"""
    return out + ", pool as (select query_id, chunk_id, row_number() over (partition by query_id order by rank, chunk_id)::int as pool_rank from sel4)"


SQL = {
    "ref_q4_hybrid": f"with {_PRIOR}, {_reserve()} select query_id, chunk_id, role, round(compatibility, 4) as compatibility, coalesce(role_rank, -1) as role_rank, round(score, 9) as score, pool_rank from pool join prior using (query_id, chunk_id)",
    "ref_w11_reserved": f"with {_PRIOR}, {_reserve()} select query_id, chunk_id, again.relationship_rank, pool_rank from pool join again using (query_id, chunk_id) where not exists (select 1 from lists l where l.query_id = pool.query_id and l.chunk_id = pool.chunk_id)",
    "ref_q1_dense": f"with {_BASE}, r as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from den1) select query_id, chunk_id, round(score, 6) as score, rank from r where rank <= 10",
    "ref_q2_lexical": f"with {_BASE} select query_id, chunk_id, round(score, 4) as score, rank from lex",
    "ref_q3_structured": f"with {_BASE} select query_id, chunk_id, exact, round(score, 4) as score, rank from str",
    "ref_w2_diversified": f"with {_BASE}, {_w2('str', 'w', 20, 2)} select query_id, chunk_id, rank from w",
    "ref_a4_fused": f"with {_FILES} select query_id, chunk_id, round(rrf_score, 9) as rrf_score, coalesce(dense_rank, -1) as dense_rank, coalesce(lexical_rank, -1) as lexical_rank, coalesce(structured_rank, -1) as structured_rank, coalesce(file_rank, -1) as file_rank, rrf_rank from fused where rrf_rank <= 50",
    "ref_w4_representatives": f"with {_FILES} select query_id, path, chunk_id, file_rank, representative, reason from reps",
    "ref_w6_anchors": f"with {_RELATED} select query_id, document_id, chunk_id, strength, anchor from an",
    "ref_j4_expansion": f"with {_RELATED} select query_id, chunk_id, type, relationship_rank from rel",
    "ref_w10_prior": f"with {_PRIOR} select query_id, chunk_id, role, round(compatibility, 4) as compatibility, coalesce(role_rank, -1) as role_rank, round(score, 9) as score, final_rank from prior where final_rank <= 100",
    "ref_p1_results": f"""with {_BASE}, x as (select distinct on (id) * from document_chunks)
      select l.query_id, l.rank, x.id as chunk_id, x.repository_id, x.language, x.start_line, x.end_line, sha256(x.content) as content_hash, x.document_id, x.source_reference, x.chunk_index, epoch_us(x.available_at) as available_us from lex l join x on x.id = l.chunk_id where l.rank <= 3""",
    "ref_p13_safety": "select 0 as foreign_items, 0 as future_items",
    "ref_a5_file_evidence": _EVIDENCE,
    "ref_f1_raw_top": f"""with {_BASE}, s as (select l.*, length(c.content) as n, sum(length(c.content)) over (partition by l.query_id order by l.rank) as total from lex l join c using (chunk_id)),
      k as (select query_id, chunk_id, rank, case when total <= 8000 then n when total - n < 8000 then 8000 - (total - n) else 0 end::int as kept, n, total from s)
      select query_id, chunk_id, rank, kept from k where kept > 0 or (n = 0 and total <= 8000)""",
}
