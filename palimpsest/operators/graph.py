"""One-hop expansion over the relationships between document versions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import roles
from ..functions import text as tx
from .ranking import first_of, rank_by

# The bounds of the expansion.
ANCHORS, NEIGHBOURS, CANDIDATES, RESERVE = 12, 3, 16, 4


def anchors(fused: DataFrame, limit: int = ANCHORS) -> DataFrame:
    """The strongest candidates, one a document: exact, found by two branches, file evidence of two sources, or among the first five.

    `fused` has query_id, chunk_id, document_id, rrf_rank, exact, branches, file_sources, file_rank (the last
    two may be null) and direct (false for rows that came by file evidence alone, which are no anchors).
    """
    strength = F.when(F.col("exact"), 0).when(F.col("branches") >= 2, 1).when(F.col("file_sources") >= 2, 2).when(F.col("rrf_rank") <= 5, 3)
    a = fused.filter(F.coalesce(F.col("direct"), F.lit(True))).withColumn("strength", strength).filter("strength is not null")
    a = a.withColumn("evidence_rank", F.least("rrf_rank", "file_rank"))
    order = [F.col("strength"), F.col("evidence_rank"), F.col("rrf_rank"), F.col("chunk_id")]
    return rank_by(first_of(a, ["query_id", "document_id"], order), ["query_id"], order, "anchor", limit)


def edges_of(anchor: DataFrame, relationships: DataFrame) -> DataFrame:
    """The relationships in force at the cutoff that leave an anchor's document, and the imports that reach it as `imported_by`.

    A union of two equi-joins; inverse edges are at module level. Anchors have query_id, anchor, document_id,
    repository_id, cutoff.
    """
    r = first_of(relationships.distinct(), ["id"], [F.col(c).desc_nulls_last() for c in relationships.columns if c != "id"]).withColumnRenamed("repository_id", "__repository")
    a = anchor.select("query_id", "anchor", "document_id", "repository_id", "cutoff")
    live = (F.col("repository_id") == F.col("__repository")) & (F.col("available_at") <= F.col("cutoff")) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > F.col("cutoff")))
    cols = ["query_id", "anchor", "cutoff", "repository_id", "edge_id", "type", "neighbour_document", "source_path", "target_path", "resolution", "target_symbol"]
    out = a.join(r, (F.col("document_id") == F.col("source_document_id")) & live).select("*", F.col("id").alias("edge_id"), F.col("relationship_type").alias("type"), F.col("target_document_id").alias("neighbour_document")).select(cols)
    back = a.join(r.filter("relationship_type = 'imports'"), (F.col("document_id") == F.col("target_document_id")) & live)
    back = back.withColumns({"resolution": F.lit("module"), "target_symbol": F.lit(None).cast("string")}).select("*", F.col("id").alias("edge_id"), F.lit("imported_by").alias("type"), F.col("source_document_id").alias("neighbour_document")).select(cols)
    return out.union(back)


def expand(anchor: DataFrame, relationships: DataFrame, chunks: DataFrame, queries: DataFrame, per_anchor: int = NEIGHBOURS, limit: int = CANDIDATES) -> DataFrame:
    """Neighbours of the anchors: rows (query_id, chunk_id, document_id, path, type, relationship_rank).

    Per anchor the best neighbours of distinct documents; across anchors in turns, each document once; of each
    document the chunk that fits best. Documents of anchors are no neighbours.
    """
    e = edges_of(anchor, relationships)
    own = anchor.select("query_id", F.col("document_id").alias("neighbour_document"))
    e = e.join(own, ["query_id", "neighbour_document"], "left_anti")
    e = e.join(queries.select("query_id", tx.symbol_terms(F.col("query")).alias("__terms")), "query_id")
    other = F.when(F.col("type") == "imported_by", F.col("source_path")).otherwise(F.col("target_path"))
    e = e.withColumn("overlap", F.size(F.array_intersect(tx.symbol_terms(F.concat_ws(" ", "target_symbol", other)), F.col("__terms"))))
    kind = F.when(F.col("type") == "imports", 0).when(F.col("type") == "reexports", 1).otherwise(2)
    order = [kind, F.when(F.col("resolution") == "exact_symbol", 0).otherwise(1), F.col("overlap").desc(), F.when(F.col("target_symbol").isNotNull(), 0).otherwise(1), F.col("source_path"), F.col("target_path"), F.col("edge_id")]
    e = rank_by(first_of(e, ["query_id", "anchor", "neighbour_document"], order), ["query_id", "anchor"], order, "turn", per_anchor)
    e = rank_by(first_of(e, ["query_id", "neighbour_document"], [F.col("turn"), F.col("anchor")]), ["query_id"], [F.col("turn"), F.col("anchor")], "relationship_rank", limit)
    c = chunks.select(F.col("document_id").alias("neighbour_document"), "chunk_id", "path", "source_type", "symbol_name", "symbol_kind", "parent_symbol", "chunk_index", "available_at", "superseded_at", F.col("repository_id").alias("__repository"))
    n = e.join(c, "neighbour_document").filter((F.col("__repository") == F.col("repository_id")) & (F.col("available_at") <= F.col("cutoff")) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > F.col("cutoff"))))
    n = n.withColumn("hit", F.size(F.array_intersect(tx.symbol_terms(F.concat_ws(" ", "symbol_name", "parent_symbol")), F.col("__terms"))))
    best = [F.when(F.coalesce(F.col("symbol_name") == F.col("target_symbol"), F.lit(False)), 0).otherwise(1), F.col("hit").desc(), roles.implementation_weight(F.col("symbol_kind")).desc(), F.when(F.coalesce(F.col("symbol_kind") == "module", F.lit(False)), 1).otherwise(0), F.col("chunk_index"), F.col("chunk_id")]
    n = first_of(n, ["query_id", "neighbour_document"], best)
    return n.select("query_id", "chunk_id", F.col("neighbour_document").alias("document_id"), "path", "source_type", "symbol_name", "symbol_kind", "type", "relationship_rank")


def reserve(pool: DataFrame, related: DataFrame, per_path: int = 2, limit: int = RESERVE, full: int = 0) -> DataFrame:
    """Swap up to `limit` candidates that only a relationship brought into the tail of the pool.

    `pool` and `related` have query_id, chunk_id, path, exact, rrf_rank, relationship_rank (null in the pool for
    direct rows). An exact or reserved row is never displaced, and no path gets beyond its cap. A pool of fewer than
    `full` rows stays as it is. The fold is over
    at most a pool of rows a query, so it runs as one grouped stage.
    """
    both = pool.select("query_id", "chunk_id", "path", "exact", "rrf_rank", "relationship_rank", F.lit(True).alias("inside"))
    both = both.unionByName(related.join(pool.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", "path", "exact", "rrf_rank", "relationship_rank", F.lit(False).alias("inside")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        selected = sorted((r for r in rows if r["inside"]), key=lambda r: (r["rrf_rank"], r["chunk_id"]))
        far = float("inf")
        wanted = sorted((r for r in rows if r["relationship_rank"] is not None), key=lambda r: (r["relationship_rank"], far if r["rrf_rank"] is None else r["rrf_rank"], r["chunk_id"]))[:limit]
        wanted = wanted if len(selected) >= full else []
        kept = {r["chunk_id"] for r in wanted}
        for r in wanted:
            if any(s["chunk_id"] == r["chunk_id"] for s in selected):
                continue
            same = 0 if r["path"] is None else sum(s["path"] == r["path"] for s in selected)
            for i in range(len(selected) - 1, -1, -1):
                s = selected[i]
                if s["exact"] or s["chunk_id"] in kept or (r["path"] is not None and same >= per_path and s["path"] != r["path"]):
                    continue
                selected[i] = r
                break
        selected.sort(key=lambda r: (far if r["rrf_rank"] is None else r["rrf_rank"], r["chunk_id"]))
        return pd.DataFrame({"query_id": [r["query_id"] for r in selected], "chunk_id": [r["chunk_id"] for r in selected], "pool_rank": range(1, len(selected) + 1)})

    return both.groupBy("query_id").applyInPandas(fold, f"query_id {dict(pool.dtypes)['query_id']}, chunk_id string, pool_rank int")


def local_context(anchor: DataFrame, chunks: DataFrame, per_anchor: int = 2) -> DataFrame:
    """Chunks of the anchors' own documents: of the same symbol, the parent symbol, or next to the anchor.

    Anchors have query_id, chunk_id, document_id, chunk_index, symbol_id, symbol_name, parent_symbol. An
    equi-join on the document with the rest as a residual. Rows (query_id, anchor_chunk, chunk_id, reason, place).
    """
    a = anchor.select("query_id", F.col("chunk_id").alias("anchor_chunk"), "document_id", F.col("chunk_index").alias("__i"), F.col("symbol_id").alias("__sid"), F.col("symbol_name").alias("__sn"), F.col("parent_symbol").alias("__ps"))
    c = chunks.select("document_id", "chunk_id", "chunk_index", "symbol_id", "symbol_name")
    near = F.abs(F.col("chunk_index") - F.col("__i")) <= 1
    same = F.coalesce(F.col("symbol_id") == F.col("__sid"), F.lit(False))
    parent = F.coalesce(F.col("symbol_name") == F.col("__ps"), F.lit(False))
    j = a.join(c, "document_id").filter((F.col("chunk_id") != F.col("anchor_chunk")) & (near | same | parent))
    reason = F.when(same, "same_symbol_context").when(parent, "parent_symbol").when(F.col("symbol_name").isNotNull() & F.col("__sn").isNotNull(), "structural_neighbor").otherwise("fallback_line_context")
    weight = F.when(same, 10).when(parent, 11).when(F.col("symbol_name").isNotNull() & F.col("__sn").isNotNull(), 14).otherwise(18)
    j = j.withColumns({"reason": reason, "priority": weight, "distance": F.abs(F.col("chunk_index") - F.col("__i"))})
    order = [F.col("priority"), F.col("distance"), F.col("chunk_index"), F.col("chunk_id")]
    return rank_by(j, ["query_id", "anchor_chunk"], order, "place", per_anchor).select("query_id", "anchor_chunk", "chunk_id", "reason", "priority", "place")


# ---- resolution of imports
def resolve_specifiers(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The file that each relative import means: rows (import_id, path, position), the first candidate that exists.

    `imports` has import_id, repository_id, directory (with trailing slash or empty) and specifier; candidates
    are the path itself, with an ending, and an index file in it, in this order.
    """
    endings = ["", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    joined = F.concat("directory", "specifier")
    # dot segments: fold the parts, a name is dropped by the .. after it; a path that leaves the root is no path
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("out")),
        lambda acc, x: F.when(x == "..", F.struct(F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0))).alias("p"), (acc["out"] | (F.size(acc["p"]) == 0)).alias("out"))).otherwise(F.struct(F.concat(acc["p"], F.array(x)).alias("p"), acc["out"].alias("out"))),
    )
    i = imports.filter(F.col("specifier").rlike(r"^\.\.?(/|$)")).withColumn("__f", folded).filter("not __f.out").withColumn("__base", F.array_join("__f.p", "/"))
    i = i.select("import_id", "repository_id", F.posexplode(F.array(*[F.concat("__base", F.lit(e)) for e in endings])).alias("position", "path"))
    hit = i.join(files.select("repository_id", "path").distinct(), ["repository_id", "path"])
    return hit.groupBy("import_id").agg(F.min_by("path", "position").alias("path"), F.min("position").alias("position"))


def closest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """The nearest configuration above each file: the deepest directory, tsconfig before jsconfig. Rows (repository_id, path, config)."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    f = files.select("repository_id", "path", F.posexplode(dirs).alias("depth", "dir"))
    c = configs.select("repository_id", F.col("path").alias("config"), F.regexp_replace("path", r"[^/]*$", "").alias("dir"), F.when(F.col("path").rlike(r"(^|/)tsconfig[^/]*\.json$"), 1).otherwise(0).alias("__ts"))
    j = f.join(c, ["repository_id", "dir"])
    return j.groupBy("repository_id", "path").agg(F.max_by("config", F.struct("depth", "__ts", "config")).alias("config"))


def resolve_aliases(imports: DataFrame, mappings: DataFrame) -> DataFrame:
    """The longest alias pattern that each import fits: rows (import_id, pattern, rest).

    A pattern holds at most one star; an exact pattern is the most specific, else the longest prefix wins.
    """
    m = mappings.withColumns({"__pre": F.substring_index("pattern", "*", 1), "__suf": F.when(F.col("pattern").contains("*"), F.substring_index("pattern", "*", -1)).otherwise(F.lit(""))})
    star = F.col("pattern").contains("*")
    j = imports.join(m, ["repository_id", "config"])
    fit = F.when(star, F.col("specifier").startswith(F.col("__pre")) & F.col("specifier").endswith(F.col("__suf")) & (F.length("specifier") >= F.length("__pre") + F.length("__suf"))).otherwise(F.col("specifier") == F.col("pattern"))
    rest = F.when(star, F.substring("specifier", F.length("__pre") + 1, F.length("specifier") - F.length("__pre") - F.length("__suf"))).otherwise(F.lit(""))
    j = j.filter(fit).withColumns({"rest": rest, "__w": F.when(star, F.length("__pre")).otherwise(F.lit(2**31 - 1))})
    return j.groupBy("import_id").agg(F.max_by("pattern", F.struct("__w", "pattern")).alias("pattern"), F.max_by("rest", F.struct("__w", "pattern")).alias("rest"))


def exact_symbols(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References (reference_id, document_id, exposed_name) to a top-level symbol, exact only if its name is unique in the document.

    Rows (reference_id, symbol_id, start_line, end_line); the lines span all parts of the symbol.
    """
    s = symbols.filter("symbol_id is not null and parent_symbol is null").groupBy("document_id", F.col("symbol_name").alias("exposed_name")).agg(F.countDistinct("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return references.join(s.filter("n = 1").drop("n"), ["document_id", "exposed_name"]).select("reference_id", "symbol_id", "start_line", "end_line")
