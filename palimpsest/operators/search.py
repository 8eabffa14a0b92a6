"""The three scored scans, for a batch of queries at once.

Queries are rows (query_id, repository_id, query, cutoff); a chunk answers only queries of its repository and
only if it is in force at their cutoff. Filters come before ranking, texts are joined last. `chunks` may repeat a
chunk_id: the row indexed last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stem as st
from ..functions import text as tx
from ..functions import vectors as vx
from ..runtime import micros
from .ranking import BRANCH_OVERFETCH, first_of, rank_by

# The weights of the four classes of positions.
A, B, C, D = 1.0, 0.4, 0.2, 0.1

#: What ranked lists carry besides their ranks.
SLIM = ["chunk_id", "path", "symbol_name", "parent_symbol", "symbol_kind", "source_type", "document_id"]


def visible(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks joined with the queries of their repository that see them at their cutoff."""
    q = queries.withColumnRenamed("repository_id", "__repository")
    on = (F.col("repository_id") == F.col("__repository")) & (F.col("available_at") <= F.col("cutoff")) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > F.col("cutoff")))
    return chunks.join(q, on, "inner").drop("__repository")


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """One row a chunk id, the one indexed last, as chunk_id. Of rows indexed at the same time any is taken: they repeat each other.

    Only ids and times are aggregated; the rows themselves meet their id's last time in one join.
    """
    last = chunks.groupBy("id").agg(F.max("indexed_at").alias("__last")).withColumnRenamed("id", "__id")
    c = chunks.join(last, (F.col("id") == F.col("__id")) & F.col("indexed_at").eqNullSafe(F.col("__last"))).drop("__id", "__last")
    return first_of(c, ["id"], [F.col("indexed_at").desc_nulls_last()]).withColumnRenamed("id", "chunk_id")


def _ranked(scores: DataFrame, chunks: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` of (query_id, chunk_id, exact, score) for each query, with the slim columns of their chunks, joined last."""
    return _described(rank_by(scores, ["query_id"], order, "rank", limit), chunks)


def _described(r: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked rows with the slim columns of their chunks."""
    about = first_of(chunks.select("indexed_at", *SLIM).join(r.select("chunk_id").distinct(), "chunk_id", "left_semi"), ["chunk_id"], [F.col("indexed_at").desc_nulls_last()])
    return r.join(about.drop("indexed_at"), "chunk_id").select("query_id", *SLIM, "exact", "score", "rank")


def _last_only(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of hits (query_id, chunk_id, indexed_at, ...) those on the row of their chunk that was indexed last."""
    last = chunks.groupBy("chunk_id").agg(F.max("indexed_at").alias("__last")).withColumnRenamed("chunk_id", "__id")
    return hits.join(last, (F.col("chunk_id") == F.col("__id")) & F.col("indexed_at").eqNullSafe(F.col("__last"))).drop("__id", "__last")


#: Values of the vectors of a block: 8,192 vectors of 512.
BLOCK = 1 << 22


def nearest(queries: DataFrame, chunks: DataFrame, embeddings: DataFrame, limit: int) -> DataFrame:
    """The ranks (query_id, chunk_id, exact, score, rank) of `dense`, without what is known of the chunks.

    Vectors travel by blocks, not by pairs: those of a repository's chunks and of its queries are cut into blocks of
    bounded size, each block of the one meets each of the other, and only the first `limit` of each query leave a meeting.
    """
    keys = {c: dict(df.dtypes)[c] for df, c in ((queries, "query_id"), (chunks, "chunk_id"))}
    of_queries = queries.groupBy("repository_id").agg(F.count("*").alias("__nq"), F.min("cutoff").alias("__from"), F.max("cutoff").alias("__to"))
    sizes = of_queries.join(embeddings.groupBy("repository_id").agg(F.count("*").alias("__ne")), "repository_id")

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) * F.col("__size") / BLOCK)

    def block(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), blocks(n))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(n) - 1))

    c = chunks.select("repository_id", "available_at", "superseded_at", "chunk_id", "indexed_at")
    c = _last_only(c, chunks).join(sizes, "repository_id").filter("available_at <= __to and (superseded_at is null or superseded_at > __from)").drop("indexed_at", "__from", "__to").distinct()
    e = embeddings.select("chunk_id", "repository_id", "embedding").withColumn("__size", F.size("embedding")).filter("__size > 0")
    c = c.join(e, ["repository_id", "chunk_id"]).select("repository_id", "__size", every("__nq").alias("__qb"), block("chunk_id", "__ne").alias("__cb"), "chunk_id", micros(F.col("available_at")).alias("since"), micros(F.col("superseded_at")).alias("until"), F.col("embedding").alias("vector"))
    q = queries.select("query_id", "repository_id", "cutoff", "vector").withColumn("__size", F.size("vector")).filter("__size > 0 and cutoff is not null").join(sizes, "repository_id")
    q = q.select("repository_id", "__size", block("query_id", "__nq").alias("__qb"), every("__ne").alias("__cb"), "query_id", micros(F.col("cutoff")).alias("cutoff"), "vector")
    by = ["repository_id", "__size", "__qb", "__cb"]
    v = q.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(vx.meeting(limit), f"query_id {keys['query_id']}, chunk_id {keys['chunk_id']}, score double")
    v = v.groupBy("query_id", "chunk_id").agg(F.max(F.round("score", 9)).alias("score")).withColumn("exact", F.lit(False))
    return rank_by(v, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], "rank", limit).select("query_id", "chunk_id", "exact", "score", "rank")


def dense(queries: DataFrame, chunks: DataFrame, embeddings: DataFrame, limit: int = BRANCH_OVERFETCH) -> DataFrame:
    """The most similar chunks of each query by cosine; queries also have `vector`, embeddings (chunk_id, repository_id, embedding).

    Vectors that are not finite, or zero, or of another size than the query's, on either side, answer nothing.
    """
    return _described(nearest(queries, chunks, embeddings, limit), chunks)


#: What a result tells of its chunk, and what of where it comes from.
RESULT = ["repository_id", "source_type", "path", "language", "commit_sha", "start_line", "end_line", "occurred_at", "available_at", "superseded_at", "content"]
METADATA = ["document_id", "source_entity_id", "parent_source_type", "parent_source_entity_id", "source_reference", "chunk_index", "symbol_id", "symbol_name", "symbol_kind", "parent_symbol", "symbol_part", "symbol_part_count"]


def results(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked rows (query_id, chunk_id, rank, score) as full results; `chunks` is the table with id, repeats and all."""
    c = latest_chunks(chunks.join(ranked.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi"))
    c = c.select("chunk_id", *RESULT, F.struct(*METADATA).alias("source_metadata"))
    return ranked.select("query_id", "chunk_id", "rank", "score").join(c, "chunk_id")


def lexemes(queries: DataFrame) -> DataFrame:
    """Rows (query_id, repository_id, cutoff, lexeme): a query's words, and their English stems but for stop words."""
    words = tx.tokens(F.col("query"))
    return queries.select("query_id", "repository_id", "cutoff", F.explode(F.array_distinct(F.concat(words, st.english(words)))).alias("lexeme"))


def lexical(queries: DataFrame, chunks: DataFrame, limit: int = BRANCH_OVERFETCH) -> DataFrame:
    """Chunks by cover density for a query of alternatives: the weights of the positions that hold one of its lexemes.

    Path and symbol weigh 1, content 0.4, the parent symbol 0.2, type, reference, language and kind 0.1. Contents are
    read by the English dictionary (stop words left out, other words stemmed), names word by word; a query asks both
    ways. Texts are cut into positions in the scan and met with the lexemes asked for in their repository before
    anything else is shuffled, so only hits travel.
    """
    q = lexemes(queries)
    row = ["chunk_id", "repository_id", "available_at", "superseded_at", "indexed_at"]
    names = F.concat(tx.tokens(F.col("path")), tx.tokens(F.col("symbol_name")))
    kinds = F.concat(*[tx.tokens(F.col(n)) for n in ("source_type", "source_reference", "language", "symbol_kind")])
    c = chunks.select(*row, F.monotonically_increasing_id().alias("__row"), names.alias("__a"), st.english(tx.tokens(F.col("content"))).alias("__b"), tx.tokens(F.col("parent_symbol")).alias("__c"), kinds.alias("__d"))

    def at(column: str, weight: float) -> Column:
        return F.transform(column, lambda t: F.struct(t.alias("lexeme"), F.lit(weight).alias("weight")))

    p = c.select(*row, "__row", F.explode(F.concat(at("__a", A), at("__b", B), at("__c", C), at("__d", D))).alias("at")).select(*row, "__row", "at.*")
    q = q.withColumnRenamed("repository_id", "__repository").withColumnRenamed("lexeme", "__lexeme")
    on = (F.col("repository_id") == F.col("__repository")) & (F.col("lexeme") == F.col("__lexeme")) & (F.col("available_at") <= F.col("cutoff")) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > F.col("cutoff")))
    hits = p.join(q, on).groupBy("query_id", "chunk_id", "indexed_at", "__row").agg(F.round(F.sum("weight"), 6).alias("score"))
    hits = _last_only(hits, chunks).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")).withColumn("exact", F.lit(False))
    return _ranked(hits, chunks, [F.col("score").desc(), F.col("chunk_id")], limit)


def structured(queries: DataFrame, chunks: DataFrame, limit: int = BRANCH_OVERFETCH) -> DataFrame:
    """Chunks whose symbol equals the trimmed query, or with names that begin with one of its terms.

    Symbol and path weigh 1, the parent symbol 0.4, the kind 0.1 a position. Exact matches come first. A query
    without terms has an empty result.
    """
    q = queries.select("query_id", "repository_id", "cutoff", tx.trim(F.col("query")).alias("__raw"), tx.structural_terms(F.col("query")).alias("__q")).filter(F.size("__q") > 0)
    row = ["chunk_id", "repository_id", "available_at", "superseded_at", "indexed_at", "symbol_name"]
    c = chunks.select(*row, F.concat(tx.path_terms(F.col("symbol_name")), tx.path_terms(F.col("path"))).alias("__a"), tx.path_terms(F.col("parent_symbol")).alias("__b"), tx.path_terms(F.col("symbol_kind")).alias("__d"))
    v = visible(q, c)

    def hits(terms: Column) -> Column:
        return F.size(F.filter(terms, lambda t: F.exists(F.col("__q"), lambda w: t.startswith(w))))

    score = hits(F.col("__a")) * A + hits(F.col("__b")) * B + hits(F.col("__d")) * D
    v = v.withColumn("exact", F.coalesce(F.col("symbol_name") == F.col("__raw"), F.lit(False))).withColumn("score", F.round(score, 6)).filter("exact or score > 0")
    v = _last_only(v.select("query_id", "chunk_id", "indexed_at", "exact", "score"), chunks).groupBy("query_id", "chunk_id").agg(F.max("exact").alias("exact"), F.max("score").alias("score"))
    return _ranked(v, chunks, [F.col("exact").desc(), F.col("score").desc(), F.col("chunk_id")], limit)
