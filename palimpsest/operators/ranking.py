"""Ranked lists: rows (query_id, branch, chunk_id, rank, ...) and what fuses, thins and re-orders them.

Every list is a table with an explicit 1-based rank; operators work on all queries at once, partitioned by
query_id, and end every order with the chunk id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import roles
from ..functions import text as tx

# The bounds of the lists.
RRF_K = 60
BRANCH_OVERFETCH, BRANCH_LIMIT, POOL, PER_PATH = 300, 100, 50, 2
FILE_LIMIT, REPRESENTATIVES, BOUNDED_CHUNKS = 50, 2, 2
PRIOR_WEIGHTS = {"none": 0.0, "weak": 0.2, "moderate": 0.5}
MIN_COMPATIBILITY = 0.75


def rank_by(df: DataFrame, by: list[str], order: list[Column], out: str = "rank", limit: int | None = None) -> DataFrame:
    """Number the rows of each group in an order; with a limit keep only the first (Spark then stops early in each partition)."""
    df = df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return df.filter(F.col(out) <= limit) if limit else df


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row a group: the first in the order, which must be total."""
    return rank_by(df, by, order, "__first", 1).drop("__first")


def diversify(df: DataFrame, limit: int, cap: int, by: list[str], rank: str = "rank", path: str = "path", exact: str = "exact") -> DataFrame:
    """Keep at most `cap` rows a path and `limit` in all, never losing the first exact match of a path.

    Closed form of the greedy rule: the first exact row of each of the first `limit` such paths is protected;
    of the others, those without path or within their path's cap (one less where a row is protected) fill the
    rest in order. Two window passes, no loop.
    """
    r = F.col(rank)
    ex = F.coalesce(F.col(exact), F.lit(False))
    per_path = Window.partitionBy(*by, F.col(path))
    d = df.withColumn("__fx", F.min(F.when(ex & F.col(path).isNotNull(), r)).over(per_path))
    d = d.withColumn("__cand", ex & F.col(path).isNotNull() & (r == F.col("__fx")))
    d = d.withColumn("__pn", F.sum(F.col("__cand").cast("int")).over(Window.partitionBy(*by).orderBy(r).rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__prot", F.col("__cand") & (F.col("__pn") <= limit))
    d = d.withColumn("__has", F.max(F.col("__prot").cast("int")).over(per_path))
    d = d.withColumn("__k", F.row_number().over(Window.partitionBy(*by, F.col(path), F.col("__prot")).orderBy(r)))
    fits = ~F.col("__prot") & (F.col(path).isNull() | (F.col("__k") <= cap - F.col("__has")))
    d = d.withColumn("__fits", fits)
    total = Window.partitionBy(*by)
    d = d.withColumn("__np", F.sum(F.col("__prot").cast("int")).over(total))
    d = d.withColumn("__fn", F.sum(F.col("__fits").cast("int")).over(total.orderBy(r).rowsBetween(Window.unboundedPreceding, 0)))
    keep = F.col("__prot") | (F.col("__fits") & (F.col("__fn") <= limit - F.col("__np")))
    return d.filter(keep).drop("__fx", "__cand", "__pn", "__prot", "__has", "__k", "__fits", "__np", "__fn")


def fuse(lists: DataFrame, branches: list[str], k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of rows (query_id, branch, chunk_id, rank): the sum of 1 / (k + rank).

    A chunk that a branch lists twice counts with its better rank. Columns: query_id, chunk_id, rrf_score,
    best_rank, <branch>_rank for each branch, rrf_rank by score, then best rank, then chunk id.
    """
    one = lists.groupBy("query_id", "branch", "chunk_id").agg(F.min("rank").alias("rank"))
    per = [F.min(F.when(F.col("branch") == b, F.col("rank"))).alias(f"{b}_rank") for b in branches]
    out = one.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"), F.min("rank").alias("best_rank"), *per)
    # sums of doubles depend on the order of rows: ranks of ties need the same bits, so the sum is over branches in order
    total = sum((F.coalesce(1.0 / (k + F.col(f"{b}_rank")), F.lit(0.0)) for b in branches[1:]), F.coalesce(1.0 / (k + F.col(f"{branches[0]}_rank")), F.lit(0.0)))
    out = out.withColumn("rrf_score", total)
    return rank_by(out, ["query_id"], [F.col("rrf_score").desc(), F.col("best_rank"), F.col("chunk_id")], "rrf_rank", limit)


def file_evidence(lists: DataFrame, strategy: str, branches: list[str], k: int = RRF_K, limit: int = FILE_LIMIT, bounded: int = BOUNDED_CHUNKS) -> DataFrame:
    """Files of each query by the evidence of their chunks: rows (query_id, path, score, best_rank, sources, file_rank).

    `max`: the best chunk's score; `multi-branch`: the sum over branches of 1 / (k + the file's best rank there);
    `bounded`: the best chunks' scores, the i-th divided by i. Rows without path are left out.
    """
    one = lists.filter("path is not null").groupBy("query_id", "path", "branch", "chunk_id").agg(F.min("rank").alias("rank"))
    if strategy == "multi-branch":
        best = one.groupBy("query_id", "path", "branch").agg(F.min("rank").alias("rank"))
        scored = best.groupBy("query_id", "path").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    else:
        chunks = one.groupBy("query_id", "path", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("s"))
        if strategy == "max":
            scored = chunks.groupBy("query_id", "path").agg(F.max("s").alias("score"))
        else:
            top = rank_by(chunks, ["query_id", "path"], [F.col("s").desc(), F.col("chunk_id")], "i", bounded)
            scored = top.groupBy("query_id", "path").agg(F.sum(F.col("s") / F.col("i")).alias("score"))
    about = one.groupBy("query_id", "path").agg(F.min("rank").alias("best_rank"), F.countDistinct("branch").alias("sources"))
    out = scored.join(about, ["query_id", "path"]).withColumn("score", F.round("score", 12))
    return rank_by(out, ["query_id"], [F.col("score").desc(), F.col("best_rank"), F.col("path")], "file_rank", limit)


def representatives(lists: DataFrame, files: DataFrame, queries: DataFrame, limit: int = REPRESENTATIVES) -> DataFrame:
    """The best chunks of each ranked file: exact, symbol overlap with the query, kind of symbol, branches, best rank, id.

    `lists` also has exact, symbol_name, parent_symbol and symbol_kind; `queries` query_id and query.
    """
    c = lists.join(files.select("query_id", "path", "file_rank"), ["query_id", "path"])
    c = c.groupBy("query_id", "path", "file_rank", "chunk_id").agg(F.max(F.coalesce(F.col("exact"), F.lit(False)).cast("int")).alias("exact"), F.min("rank").alias("best_rank"), F.countDistinct("branch").alias("branches"), F.max("symbol_name").alias("symbol_name"), F.max("parent_symbol").alias("parent_symbol"), F.max("symbol_kind").alias("symbol_kind"))
    c = c.join(queries.select("query_id", tx.symbol_terms(F.col("query")).alias("__terms")), "query_id")
    c = c.withColumn("overlap", F.size(F.array_intersect(tx.symbol_terms(F.concat_ws(" ", "symbol_name", "parent_symbol")), F.col("__terms")))).drop("__terms")
    c = c.withColumn("implementation", roles.implementation_weight(F.col("symbol_kind")))
    order = [F.col("exact").desc(), F.col("overlap").desc(), F.col("implementation").desc(), F.col("branches").desc(), F.col("best_rank"), F.col("chunk_id")]
    c = rank_by(c, ["query_id", "path"], order, "representative", limit)
    reason = F.when(F.col("exact") == 1, "exact-symbol").when(F.col("overlap") > 0, "query-symbol-overlap").when(F.col("implementation") > 0, "implementation-symbol").when(F.col("branches") > 1, "multi-branch-chunk").otherwise("best-direct-rank")
    return c.withColumn("reason", reason)


def role_prior(fused: DataFrame, strategy: str = "weak", k: int = RRF_K) -> DataFrame:
    """Re-rank by how well roles suit the query's intents.

    `fused` has query_id, chunk_id, rrf_score, rrf_rank, compatibility. Rows of at least 0.75 get a role rank in
    the order of rrf_rank and w / (k + role rank) on their score; ranks are given at weight 0 too.
    """
    w = PRIOR_WEIGHTS[strategy]
    fits = F.col("compatibility") >= MIN_COMPATIBILITY
    ranked = fused.withColumn("__fits", fits)
    ranked = ranked.withColumn("role_rank", F.when(F.col("__fits"), F.row_number().over(Window.partitionBy("query_id", "__fits").orderBy("rrf_rank", "chunk_id"))))
    ranked = ranked.withColumn("prior_score", F.coalesce(F.lit(w) / (k + F.col("role_rank")), F.lit(0.0))).withColumn("score", F.col("rrf_score") + F.col("prior_score"))
    return rank_by(ranked.drop("__fits"), ["query_id"], [F.col("score").desc(), F.col("rrf_rank"), F.col("chunk_id")], "final_rank")


def rerank(pool: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """The pool in the order of a reranker's scores (query_id, chunk_id, score), then of rrf_rank, then of id.

    Every row of the pool must have exactly one finite score; a missing, repeated or non-finite one is an error.
    """
    s = scores.groupBy("query_id", "chunk_id").agg(F.max("score").alias("rerank_score"), F.count("*").alias("__n"))
    j = pool.join(s, ["query_id", "chunk_id"], "left")
    ok = (F.col("__n") == 1) & F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score") & (F.abs("rerank_score") != float("inf"))
    j = j.withColumn("rerank_score", F.when(F.coalesce(ok, F.lit(False)), F.col("rerank_score")).otherwise(F.raise_error(F.lit("each candidate needs one finite score")).cast("double"))).drop("__n")
    return rank_by(j, ["query_id"], [F.col("rerank_score").desc(), F.col("rrf_rank"), F.col("chunk_id")], "final_rank", limit)
