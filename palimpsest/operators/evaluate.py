"""Relevance metrics of ranked results against graded targets, and their aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import rank_by

SELECTOR = ["path", "source_type", "source_reference", "symbol_name"]


def selects(target: str = "t_", result: str = "") -> Column:
    """Whether a target means a result: every field that the target specifies is equal, and one is specified."""
    c = F.lit(True)
    for f in SELECTOR:
        c = c & (F.col(target + f).isNull() | F.coalesce(F.col(target + f) == F.col(result + f), F.lit(False)))
    return c & F.coalesce(*[F.col(target + f) for f in SELECTOR]).isNotNull()


def credit(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (case_id, rank, target_id, grade): each result credits the best target it means that no earlier one did.

    `targets` has case_id, target_id, grade and t_<field> for the selector fields. Pairs are formed within a case
    by equi-join and the selector; where a target's first result and a result's best target agree no fold is
    needed, but contested ones need one, over the few pairs of a case.
    """
    j = results.join(targets, "case_id").filter(selects()).select("case_id", "rank", "target_id", "grade")
    kind = dict(results.dtypes)["case_id"]
    tid = dict(targets.dtypes)["target_id"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for rank, g in pdf.sort_values(["rank", "grade", "target_id"], ascending=[True, False, True]).groupby("rank", sort=True):
            for r in g.itertuples():
                if r.target_id not in used:
                    used.add(r.target_id)
                    out.append((r.case_id, rank, r.target_id, r.grade))
                    break
        return pd.DataFrame(out, columns=["case_id", "rank", "target_id", "grade"])

    return j.groupBy("case_id").applyInPandas(one, f"case_id {kind}, rank int, target_id {tid}, grade int")


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / (F.log(rank + 1.0) / F.log(F.lit(2.0)))


def metrics(cases: DataFrame, credits: DataFrame, targets: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Rows (case_id, k, hit, precision, recall, ndcg, mrr), one a case and cutoff.

    Precision is divided by k even if fewer results came; the reciprocal rank looks at the largest cutoff; a
    case without targets has recall and nDCG 0.
    """
    top = max(cutoffs)
    ks = F.explode(F.array(*[F.lit(k) for k in sorted(set(cutoffs))])).alias("k")
    base = cases.select("case_id").distinct().select("case_id", ks)
    ideal = rank_by(targets.select("case_id", "target_id", "grade"), ["case_id"], [F.col("grade").desc(), F.col("target_id")], "place")
    want = base.join(ideal, "case_id", "left").groupBy("case_id", "k").agg(F.count("target_id").alias("targets"), F.coalesce(F.sum(F.when(F.col("place") <= F.col("k"), gain(F.col("grade"), F.col("place")))), F.lit(0.0)).alias("ideal"))
    got = base.join(credits, "case_id", "left").groupBy("case_id", "k").agg(
        F.coalesce(F.sum(F.when(F.col("rank") <= F.col("k"), 1)), F.lit(0)).alias("found"),
        F.coalesce(F.sum(F.when(F.col("rank") <= F.col("k"), gain(F.col("grade"), F.col("rank")))), F.lit(0.0)).alias("dcg"),
        F.min(F.when(F.col("rank") <= top, F.col("rank"))).alias("first"),
    )
    j = want.join(got, ["case_id", "k"])
    return j.select(
        "case_id",
        "k",
        F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("hit"),
        (F.col("found") / F.col("k")).alias("precision"),
        F.coalesce(F.col("found") / F.nullif(F.col("targets"), F.lit(0)), F.lit(0.0)).alias("recall"),
        F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def summarise(per_case: DataFrame, by: list[str], category: str) -> DataFrame:
    """Means over cases, overall (category null) and by category, in one pass."""
    m = ["hit", "precision", "recall", "ndcg", "mrr"]
    keys = [*by, category]
    g = per_case.groupingSets([keys, by], *keys) if by else per_case.groupingSets([[category], []], category)
    return g.agg(F.count("*").alias("cases"), *[F.avg(x).alias(x) for x in m])


def ratio_of_sums(a: str, b: str) -> Column:
    """A ratio over all cases: the quotient of the sums, not the mean of quotients; 0 for an empty denominator."""
    return F.coalesce(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), F.lit(0.0))


def histogram(df: DataFrame, by: list[str], value: str, values: list[str]) -> DataFrame:
    """Counts of each of the given values in each group, those that do not occur with 0."""
    have = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    full = groups.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(value))
    return full.join(have, [*by, value], "left").withColumn("n", F.coalesce("n", F.lit(0)))
