"""Evaluation of evidence packs and candidate pools: what of the wanted is there, what is noise, and why the rest is missing.

Evidence rows have case_id, item (order), path, source_type, source_reference, symbol_name, start_line, end_line,
content and relationships (an array of structs with imported_name, target_symbol, resolution; null or empty if none).
Targets have case_id, target_id, need ('required' or 'supporting') and t_<selector fields>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import roles as ro
from .evaluate import ratio_of_sums, selects
from .pack import repeated_evidence

#: Metrics that are averaged over cases, and ratios of sums with what they divide.
MEANS = """required_recall supporting_recall complete precision duplicate_ratio budget_use distinct_relevant_files noise items characters
relationship_items relationship_labelled symbol_bearing exact_symbol module_only""".split()
RATIOS = {"relationship_precision": ("relationship_labelled", "relationship_items"), "exact_target_rate": ("exact_symbol", "symbol_bearing"), "module_only_rate": ("module_only", "relationship_items")}


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(empty))


def case_metrics(cases: DataFrame, evidence: DataFrame, targets: DataFrame, budget: int) -> DataFrame:
    """One row a case: recall of required and supporting targets (1 where no supporting are wanted), whether complete, precision,
    noise, share of repeated items, use of the budget, distinct relevant files, and what relationships brought."""
    hit = evidence.join(targets, "case_id").filter(selects())
    met = hit.select("case_id", "target_id").distinct().withColumn("met", F.lit(1))
    t = targets.join(met, ["case_id", "target_id"], "left").groupBy("case_id").agg(
        F.count_if(F.col("need") == "required").alias("required"), F.count_if((F.col("need") == "required") & F.col("met").isNotNull()).alias("required_met"),
        F.count_if(F.col("need") == "supporting").alias("supporting"), F.count_if((F.col("need") == "supporting") & F.col("met").isNotNull()).alias("supporting_met"),
    )
    relevant = hit.select("case_id", "item").distinct().withColumn("relevant", F.lit(True))
    e = evidence.join(relevant, ["case_id", "item"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    rel = F.coalesce("relationships", F.array().cast(dict(evidence.dtypes)["relationships"]))
    derived = F.size(rel) > 0
    bearing = derived & F.exists(rel, lambda r: r["imported_name"].isNotNull())
    exact = bearing & F.exists(rel, lambda r: (r["resolution"] == "exact_symbol") & F.coalesce(r["target_symbol"] == F.col("symbol_name"), F.lit(False)))
    module = derived & F.forall(rel, lambda r: r["resolution"] == "exact_module")
    n = e.groupBy("case_id").agg(
        F.count("*").alias("items"), F.count_if("relevant").alias("relevant_items"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("characters"),
        F.countDistinct(F.when(F.col("relevant"), F.col("path"))).alias("distinct_relevant_files"),
        F.count_if(derived).alias("relationship_items"), F.count_if(derived & F.col("relevant")).alias("relationship_labelled"),
        F.count_if(bearing).alias("symbol_bearing"), F.count_if(exact).alias("exact_symbol"), F.count_if(module).alias("module_only"),
    )
    again = repeated_evidence(evidence.withColumnRenamed("case_id", "query_id").select("query_id", "item", "content", "path", "symbol_name", "start_line", "end_line")).select(F.col("query_id").alias("case_id"), "repeated")
    j = cases.select("case_id").distinct().join(t, "case_id", "left").join(n, "case_id", "left").join(again, "case_id", "left").fillna(0)
    precision = _ratio(F.col("relevant_items"), F.col("items"))
    return j.select(
        "case_id", _ratio(F.col("required_met"), F.col("required")).alias("required_recall"), _ratio(F.col("supporting_met"), F.col("supporting"), 1.0).alias("supporting_recall"),
        (F.col("required_met") == F.col("required")).cast("int").alias("complete"), precision.alias("precision"), (1 - precision).alias("noise"), _ratio(F.col("repeated"), F.col("items")).alias("duplicate_ratio"),
        (F.col("characters") / budget).alias("budget_use"), "distinct_relevant_files", "items", "characters", "relationship_items", "relationship_labelled", "symbol_bearing", "exact_symbol", "module_only",
        *[_ratio(F.col(a), F.col(b)).alias(k) for k, (a, b) in RATIOS.items()],
    )


def summarise(per_case: DataFrame, category: str) -> DataFrame:
    """Means over all cases (category null) and by category; rates of relationships are ratios of sums, not means of ratios."""
    return per_case.groupingSets([[category], []], category).agg(F.count("*").alias("cases"), *[F.avg(m).alias(m) for m in MEANS], *[ratio_of_sums(a, b).alias(k) for k, (a, b) in RATIOS.items()])


def outcomes(targets: DataFrame, results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Why each target was met or not: rows (case_id, target_id, final_rank, candidate_rank, outcome).

    `results` and `candidates` have case_id, rank and the selector fields. A target is successfully_returned,
    reranked_below_cutoff (a candidate, but no result), wrong_chunk_from_target_file, or absent_from_candidate_pool.
    """
    best = lambda d, name: targets.join(d, "case_id").filter(selects()).groupBy("case_id", "target_id").agg(F.min("rank").alias(name))
    same_file = F.coalesce(F.col("t_path") == F.col("path"), F.lit(False)) & (F.col("t_source_type").isNull() | F.coalesce(F.col("t_source_type") == F.col("source_type"), F.lit(False)))
    file = targets.join(candidates, "case_id").filter(same_file).select("case_id", "target_id").distinct().withColumn("in_file", F.lit(True))
    j = targets.select("case_id", "target_id").join(best(results, "final_rank"), ["case_id", "target_id"], "left").join(best(candidates, "candidate_rank"), ["case_id", "target_id"], "left").join(file, ["case_id", "target_id"], "left")
    o = F.when(F.col("final_rank").isNotNull(), "successfully_returned").when(F.col("candidate_rank").isNotNull(), "reranked_below_cutoff").when(F.col("in_file"), "wrong_chunk_from_target_file").otherwise("absent_from_candidate_pool")
    return j.withColumn("outcome", o).drop("in_file")


def relationship_effect(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per case: candidates that relationships ranked, those only they brought, of these the ones no target means, and targets met by these alone.

    `candidates` also has relationship_rank and direct.
    """
    c = candidates.withColumn("only", F.col("relationship_rank").isNotNull() & ~F.col("direct"))
    met = targets.join(c.filter("only"), "case_id").filter(selects())
    hit = met.select("case_id", "rank").distinct().withColumn("meant", F.lit(True))
    n = c.join(hit, ["case_id", "rank"], "left").groupBy("case_id").agg(F.count_if(F.col("relationship_rank").isNotNull()).alias("relationship_candidates"), F.count_if("only").alias("relationship_only"), F.count_if(F.col("only") & F.col("meant").isNull()).alias("relationship_false"))
    return n.join(met.groupBy("case_id").agg(F.countDistinct("target_id").alias("recovered")), "case_id", "left").fillna(0, ["recovered"])


def role_effect(before: Column, candidate: Column, final: Column, in_file: Column, cutoff: int) -> Column:
    """What the prior of roles did to a target: its ranks before the prior, among the candidates and in the result."""
    c = F.when(candidate.isNull(), F.when(in_file, "wrong_chunk_from_target_file").otherwise("candidate_missing"))
    c = c.when((before > cutoff) & (candidate <= cutoff), "role_prior_promoted_candidate").when((before <= cutoff) & (candidate > cutoff), "role_prior_demoted_candidate")
    c = c.when((candidate <= cutoff) & final.isNull(), "reranker_reversed_useful_order").when((candidate > cutoff) & final.isNull(), "compatible_candidate_below_cutoff")
    return c.otherwise("unchanged")


def target_role(source_type: Column, path: Column) -> Column:
    """The role that a target's selector names: by type and path, by path alone as source code, else unknown."""
    none = F.lit(None).cast("string")
    return F.when(source_type.isNotNull(), ro.classify(source_type, path, none)["role"]).when(path.isNotNull() & (path != ""), ro.classify(F.lit("source_code"), path, none)["role"]).otherwise("unknown")


def failure_report(per_case: DataFrame) -> DataFrame:
    """Cases that miss something required, worst first."""
    return per_case.filter("required_recall < 1").orderBy("required_recall", F.col("noise").desc(), "case_id")


def isolated(evidence: DataFrame, cases: DataFrame) -> DataFrame:
    """The evidence, or an error if an item is of another repository than its case or from after its cutoff.

    `evidence` has repository_id and available_at, `cases` case_id, repository_id and cutoff.
    """
    q = cases.select("case_id", F.col("repository_id").alias("__r"), F.col("cutoff").alias("__t"))
    bad = (F.col("repository_id") != F.col("__r")) | (F.col("available_at") > F.col("__t"))
    e = evidence.join(q, "case_id").withColumn("__ok", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("evidence breaks repository isolation or the cutoff")).cast("boolean")).otherwise(F.lit(True)))
    return e.filter("__ok").drop("__ok", "__r", "__t")


def revisions(evidence: DataFrame) -> DataFrame:
    """The distinct revisions of each case's evidence, in order."""
    return evidence.groupBy("case_id").agg(F.sort_array(F.collect_set("commit_sha")).alias("revisions"))
