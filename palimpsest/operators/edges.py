"""The relationship builder: bindings resolved to files and symbols, with identity, availability and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .ranking import first_of

KINDS = ["relative", "path_alias", "base_url"]


def directory(path):
    return F.regexp_replace(path, r"[^/]*$", "")


def resolve(bindings: DataFrame, files: DataFrame, mappings: DataFrame | None = None, bases: DataFrame | None = None) -> DataFrame:
    """Bindings (import_id, repository_id, path, specifier) with status, module_kind, target_path and config.

    A specifier that begins with a dot is relative. Others go by the longest alias of the closest configuration
    (`mappings`: repository_id, config, pattern, target, place), its targets in order, then by its base folder
    (`bases`: repository_id, config, base); what neither has is external, or, where an alias fits but no file does,
    unresolved. Two files for the same place of an alias are ambiguous.
    """
    b = bindings.withColumn("directory", directory(F.col("path")))
    relative = F.col("specifier").rlike(r"^\.\.?(/|$)")
    near = graph.resolve_specifiers(b.filter(relative), files).select("import_id", F.col("path").alias("target_path"))
    out = b.filter(relative).join(near, "import_id", "left").withColumns({"module_kind": F.lit("relative"), "config": F.lit(None).cast("string"), "status": F.when(F.col("target_path").isNotNull(), "resolved").otherwise("unresolved")})
    other = b.filter(~F.coalesce(relative, F.lit(False)))
    if mappings is None and bases is None:
        return out.unionByName(other.withColumns({"target_path": F.lit(None).cast("string"), "module_kind": F.lit(None).cast("string"), "config": F.lit(None).cast("string"), "status": F.lit("external")}))
    configs = (mappings if bases is None else bases if mappings is None else mappings.select("repository_id", "config").union(bases.select("repository_id", "config"))).select("repository_id", F.col("config").alias("path")).distinct()
    closest = graph.closest_config(other.select("repository_id", "path").distinct(), configs)
    o = other.join(closest, ["repository_id", "path"], "left")
    found = o.withColumns({"alias_path": F.lit(None).cast("string"), "aliased": F.lit(False), "doubtful": F.lit(False)})
    if mappings is not None:
        fit = graph.resolve_aliases(o.filter("config is not null").select("import_id", "repository_id", "config", "specifier"), mappings.select("repository_id", "config", "pattern").distinct())
        t = fit.join(o.select("import_id", "repository_id", "config"), "import_id").join(mappings, ["repository_id", "config", "pattern"])
        t = t.select(F.concat("import_id", F.lit("#"), "place").alias("import_id"), F.col("import_id").alias("own"), "repository_id", F.lit("").alias("directory"), F.concat(F.lit("./"), F.replace("target", F.lit("*"), F.col("rest"))).alias("specifier"), "place")
        hit = graph.resolve_specifiers(t, files).select("import_id", F.col("path").alias("alias_path")).join(t.select("import_id", "own", "place"), "import_id")
        best = hit.groupBy("own").agg(F.min("place").alias("place"))
        one = hit.join(best, ["own", "place"]).groupBy("own").agg(F.min("alias_path").alias("alias_path"), (F.countDistinct("alias_path") > 1).alias("doubtful"))
        found = o.join(fit.select("import_id", F.lit(True).alias("aliased")), "import_id", "left").join(one.withColumnRenamed("own", "import_id"), "import_id", "left")
        found = found.withColumns({"aliased": F.coalesce("aliased", F.lit(False)), "doubtful": F.coalesce("doubtful", F.lit(False))})
    found = found.withColumn("base_path", F.lit(None).cast("string"))
    if bases is not None:
        w = found.filter("not aliased").join(bases, ["repository_id", "config"]).select("import_id", "repository_id", F.lit("").alias("directory"), F.concat(F.lit("./"), "base", F.lit("/"), "specifier").alias("specifier"))
        found = found.drop("base_path").join(graph.resolve_specifiers(w, files).select("import_id", F.col("path").alias("base_path")), "import_id", "left")
    kind = F.when(F.col("aliased"), "path_alias").when(F.col("base_path").isNotNull(), "base_url")
    status = F.when(F.col("doubtful"), "ambiguous").when(F.coalesce("alias_path", "base_path").isNotNull(), "resolved").when(F.col("aliased"), "unresolved").otherwise("external")
    found = found.withColumns({"target_path": F.coalesce("alias_path", "base_path"), "module_kind": kind, "status": status})
    return out.unionByName(found.select(out.columns))


def build(bindings: DataFrame, documents: DataFrame, symbols: DataFrame, mappings: DataFrame | None = None, bases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(relationships, diagnostics by repository).

    `bindings` are those of extract_imports; `documents` the current source files, one a path (id, repository_id,
    path, commit_sha, available_at); `symbols` their chunks (document_id, symbol_id, symbol_name, symbol_kind,
    parent_symbol, start_line, end_line). A relationship is exact at the symbol if the imported name is one
    top-level symbol of the target, else at the module, and available when both ends and its configuration are.
    """
    d = first_of(documents.filter("path is not null and commit_sha is not null"), ["repository_id", "path"], [F.col("available_at").desc(), F.col("id")])
    s = d.select(F.col("id").alias("document_id"), "repository_id", "path", F.col("commit_sha").alias("source_commit_sha"), F.col("available_at").alias("__sa"))
    b = bindings.join(s, "document_id")
    b = b.withColumn("import_id", F.sha2(F.concat_ws("\x00", "document_id", "line", "specifier", "kind", "binding", "imported", "local"), 256))
    r = resolve(b.select("import_id", "repository_id", "path", "specifier").distinct(), d, mappings, bases).select("import_id", "status", "module_kind", "target_path", "config")
    j = b.join(r, "import_id")
    t = d.select("repository_id", F.col("path").alias("target_path"), F.col("id").alias("target_document_id"), F.col("commit_sha").alias("target_commit_sha"), F.col("available_at").alias("__ta"))
    c = d.select("repository_id", F.col("path").alias("config"), F.col("available_at").alias("__ca"), F.col("commit_sha").alias("configuration_commit_sha"))
    e = j.filter("status = 'resolved'").join(t, ["repository_id", "target_path"]).join(c, ["repository_id", "config"], "left")
    refs = e.filter("imported is not null and imported not in ('*', 'default')").select(F.col("import_id").alias("reference_id"), F.col("target_document_id").alias("document_id"), F.col("imported").alias("exposed_name")).distinct()
    exact = graph.exact_symbols(refs, symbols).select(F.col("reference_id").alias("import_id"), F.col("start_line").alias("target_start_line"), F.col("end_line").alias("target_end_line"), "symbol_id")
    kinds = symbols.filter("symbol_id is not null").groupBy("symbol_id").agg(F.min("symbol_kind").alias("target_symbol_kind"))
    e = e.join(exact.join(kinds, "symbol_id", "left").drop("symbol_id"), "import_id", "left")
    resolution = F.when(F.col("target_start_line").isNotNull(), "exact_symbol").otherwise("exact_module")
    e = e.withColumns({"resolution": resolution, "available_at": F.greatest("__sa", "__ta", "__ca"), "target_symbol": F.when(F.col("target_start_line").isNotNull(), F.col("imported"))})
    parts = ["repository_id", "document_id", "target_document_id", "kind", F.coalesce("imported", F.lit("")), F.coalesce("local", F.lit("")), F.lit(""), "binding", F.col("type_only").cast("int").cast("string"), "resolution", "module_kind", F.col("line").cast("string")]
    e = e.withColumn("id", F.sha2(F.concat_ws("\x00", F.lit("source_relationship_v2"), *parts), 256))
    out = e.select("id", "repository_id", F.col("document_id").alias("source_document_id"), "target_document_id", F.col("kind").alias("relationship_type"), F.col("path").alias("source_path"), "target_path", "target_symbol", F.col("imported").alias("imported_name"), F.col("local").alias("local_name"), F.col("binding").alias("binding_kind"), F.col("type_only").alias("is_type_only"), "resolution", F.col("module_kind").alias("module_resolution_kind"), "target_symbol_kind", "target_start_line", "target_end_line", F.col("config").alias("configuration_path"), "configuration_commit_sha", "source_commit_sha", "target_commit_sha", "available_at", F.col("line").alias("source_start_line"), F.concat_ws("", "kind", F.lit(" "), "specifier", F.lit(" ("), "module_kind", F.lit(", "), "resolution", F.lit(")")).alias("reason"))
    out = first_of(out, ["id"], [F.col("target_path"), F.col("reason")])

    def n(condition: str, name: str):
        return F.count_if(F.expr(condition)).alias(name)

    counts = j.groupBy("repository_id").agg(F.count("*").alias("parsed"), n("status = 'external'", "external"), *[n(f"module_kind = '{k}' and status <> 'external'", k) for k in KINDS], *[n(f"module_kind = '{k}' and status = 'resolved'", f"resolved_{k}") for k in KINDS], n("status = 'unresolved'", "unresolved_local"), n("status = 'ambiguous'", "ambiguous_local"))
    more = e.groupBy("repository_id").agg(F.count("*").alias("relationships"), n("resolution = 'exact_symbol'", "exact_symbol"), n("resolution = 'exact_module'", "exact_module"), n("imported is not null", "symbol_bearing"), n("kind = 'imports'", "imports"), n("kind = 'reexports'", "reexports"), F.countDistinct("config").alias("configurations"))
    return out, counts.join(more, "repository_id", "left").fillna(0)


def canonical(relationships: DataFrame) -> DataFrame:
    """Relationships in their canonical order."""
    return relationships.orderBy("repository_id", "source_path", "source_start_line", "relationship_type", "target_path", F.coalesce("imported_name", F.lit("")), "id")
