"""What a request must be before anything runs: search inputs, options, repositories that are ready, reranker answers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import rank_by, rerank

# Bounds of a request.
DEFAULT_LIMIT, MAX_LIMIT, MAX_INTERNAL = 10, 100, 1000
MIN_BUDGET, MAX_BUDGET, MAX_QUERY = 256, 100_000, 4_000
# Why a request is refused.
CODES = """invalid_repository invalid_query query_too_long invalid_cutoff invalid_limit invalid_budget unknown_repository deleted_repository
not_indexed embeddings_missing reranker_unavailable""".split()


class RequestError(ValueError):
    def __init__(self, code: str, detail: str):
        assert code in CODES
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Search:
    repository_id: str
    query: str
    limit: int
    cutoff: datetime


def normalised(repository_id: str, query: str, limit: int | None = None, cutoff: datetime | None = None, most: int = MAX_LIMIT) -> Search:
    """A search with its defaults: trimmed, 10 results, and as of now. The cutoff is fixed here, so a plan can be run again."""
    import uuid

    try:
        uuid.UUID(repository_id)
    except (ValueError, AttributeError, TypeError):
        raise RequestError("invalid_repository", repr(repository_id)) from None
    q = (query or "").strip()
    if not q:
        raise RequestError("invalid_query", "a query needs words")
    if len(q) > MAX_QUERY:
        raise RequestError("query_too_long", f"{len(q)} characters")
    n = DEFAULT_LIMIT if limit is None else limit
    if isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= most:
        raise RequestError("invalid_limit", f"{n!r} is not between 1 and {most}")
    at = datetime.now(timezone.utc) if cutoff is None else cutoff
    if not isinstance(at, datetime):
        raise RequestError("invalid_cutoff", repr(cutoff))
    return Search(repository_id, q, n, at)


def positive(**options: int) -> None:
    """Options of ranked operators: each a whole number of at least 1."""
    for name, v in options.items():
        if isinstance(v, bool) or not isinstance(v, int) or v < 1:
            raise ValueError(f"{name} must be a positive whole number, not {v!r}")


def budget(characters: int) -> int:
    if isinstance(characters, bool) or not isinstance(characters, int) or not MIN_BUDGET <= characters <= MAX_BUDGET:
        raise RequestError("invalid_budget", f"{characters!r} is not between {MIN_BUDGET} and {MAX_BUDGET}")
    return characters


def ready(catalogue: DataFrame, repository_id: str) -> dict:
    """The repository's row of the catalogue, if it can be asked: known, not deleted, indexed, and with embeddings."""
    rows = catalogue.filter(F.col("repository_id") == repository_id).limit(1).collect()  # one row
    if not rows:
        raise RequestError("unknown_repository", repository_id)
    r = rows[0].asDict()
    if r.get("deleted_at") is not None:
        raise RequestError("deleted_repository", repository_id)
    if r.get("indexed_us", 0) in (None, -1):
        raise RequestError("not_indexed", repository_id)
    if not r.get("ready"):
        raise RequestError("embeddings_missing", repository_id)
    return r


# ---- reranking
#: A reranker: a query and texts to one score a text.
Reranker = Callable[[str, list[str]], list[float]]


def rerank_text(path, source_type, start_line, end_line, language, symbol_name, parent_symbol, source_reference, content):
    """The text a reranker reads of a chunk: labelled lines, absent ones left out, then the content."""

    def line(label: str, c):
        return F.concat(F.lit(f"{label}: "), F.nullif(c.cast("string"), F.lit("")))

    lines = F.when(start_line.isNotNull() & end_line.isNotNull(), F.concat(F.lit("Lines: "), start_line.cast("string"), F.lit("-"), end_line.cast("string")))
    return F.concat_ws("\n", line("Path", path), line("Type", source_type), lines, line("Language", language), line("Symbol", symbol_name), line("Parent", parent_symbol), line("Reference", source_reference), F.concat(F.lit("Content:\n"), F.coalesce(content, F.lit(""))))


def scores_of(reranker: Reranker, query: str, texts: list[str]) -> list[float]:
    """The reranker's scores; another number of them, or one that is not finite, is an error."""
    out = reranker(query, texts)
    if len(out) != len(texts) or not all(isinstance(x, (int, float)) and math.isfinite(x) for x in out):
        raise ValueError("a reranker gives one finite score a candidate")
    return [float(x) for x in out]


def reranked(pool: DataFrame, queries: DataFrame, reranker: Reranker, limit: int, pool_size: int = 50) -> DataFrame:
    """The pool in the reranker's order. `pool` has query_id, chunk_id, rrf_rank and rerank_text, `queries` query_id and query.

    Candidates of a query, a pool of them at most, go to the reranker in one call; empty texts and repeated chunks are errors.
    """
    positive(limit=limit, pool_size=pool_size)
    if limit > pool_size:
        raise ValueError("the limit is beyond the pool")
    kind = dict(pool.dtypes)["query_id"]
    p = rank_by(pool, ["query_id"], [F.col("rrf_rank"), F.col("chunk_id")], "__in", pool_size).drop("__in")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rrf_rank", "chunk_id"])
        if pdf["chunk_id"].duplicated().any() or (pdf["rerank_text"].fillna("").str.strip() == "").any():
            raise ValueError("candidates need distinct ids and texts")
        return pd.DataFrame({"query_id": pdf["query_id"], "chunk_id": pdf["chunk_id"], "score": scores_of(reranker, pdf["query"].iloc[0], pdf["rerank_text"].tolist())})

    scores = p.join(queries.select("query_id", "query"), "query_id").select("query_id", "query", "chunk_id", "rrf_rank", "rerank_text").groupBy("query_id").applyInPandas(one, f"query_id {kind}, chunk_id string, score double")
    return rerank(p.drop("rerank_text"), scores, limit)


def diagnostics(pool: DataFrame) -> DataFrame:
    """Per query: candidates sent to a reranker and the bytes of their texts in UTF-8."""
    return pool.groupBy("query_id").agg(F.count("*").alias("candidates"), F.coalesce(F.sum(F.octet_length("rerank_text")), F.lit(0)).alias("bytes"))


def overlap_reranker(query: str, texts: list[str]) -> list[float]:
    """A deterministic reranker for tests: the share of the query's words that a text has."""
    import re

    q = set(re.findall(r"\w+", query.lower()))
    return [len(q & set(re.findall(r"\w+", t.lower()))) / max(1, len(q)) for t in texts]


def sanitised(error: str, *secrets: str) -> str:
    """An error's text without what was sent, quoted text and long tokens, 500 characters at most."""
    import re

    for s in secrets:
        if s:
            error = error.replace(s, "[input]")
    error = re.sub(r"\"[^\"]*\"|'[^']*'", "[quoted]", error)
    return re.sub(r"[A-Za-z0-9_\-]{24,}", "[token]", error)[:500]


