"""Problem 4: source files that do not parse.

Every file is put to all supported grammars, in the order of a ranking by its tokens. What fails the grammar of the
language that its path names is no valid file: the first other grammar that takes it is what it really is (a wrong
extension); if none does, it is corrupt (truncated, in conflict, damaged).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grammars as G
from .arrow import map_rows
from .texts import load

_SCHEMA = "file_id string, repository_id string, path string, language string, is_valid boolean, verdict string, parsed_as string, fault string, parses_as array<string>"


def _judge(file_id, repository_id, path, text):
    language = G.LANGUAGE_OF[path.rsplit(".", 1)[-1].lower()]
    said = {k: G.parse(text, k) for k in G.rank(text)}
    takes = [k for k, (fault, _) in said.items() if fault is None]
    fault, deep = said[language]
    if fault is None:
        verdict, parsed_as = "too_deep" if deep else "valid", language
    elif "<<<<<<<" in text and ">>>>>>>" in text and "=======" in text:
        verdict, parsed_as = "merge_conflict", None
    elif takes and text.strip():
        verdict, parsed_as = "wrong_extension", takes[0]
    else:
        # a text that any grammar of the kind takes tells nothing: an empty SQL script
        verdict, parsed_as = "corrupt", None
    yield file_id, repository_id, path, language, fault is None, verdict, parsed_as, fault, takes


def judge_files(texts: DataFrame) -> DataFrame:
    """Rows (file_id, repository_id, path, language, is_valid, verdict, parsed_as, fault, parses_as), one a file.

    parses_as names all grammars that take the text, in the order of the ranking; parsed_as is the path's language,
    or what a file with a wrong extension is.

    `texts` has id, repository_id, path and text. Files with null path or text, or with an ending of no
    supported language, are no cases. An empty text is valid in every language but JSON and Go. Of texts
    that nest deeper than the recognisers follow only tokens and brackets are checked (verdict too_deep), but JSON
    is read at any depth.
    """
    t = texts.select("id", "repository_id", "path", "text").filter(F.col("text").isNotNull() & F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(list(G.LANGUAGE_OF)))
    return map_rows(t, _SCHEMA, _judge)


def rates(judged: DataFrame) -> DataFrame:
    """Files, invalid files and their share per repository and language."""
    bad = F.sum(F.when(F.col("is_valid"), 0).otherwise(1))
    by = judged.groupBy("repository_id", "language").agg(
        F.count("*").alias("files"),
        bad.alias("invalid_files"),
        F.sum(F.when(F.col("verdict") == "wrong_extension", 1).otherwise(0)).alias("wrong_extension_files"),
        F.sum(F.when(F.col("verdict") == "merge_conflict", 1).otherwise(0)).alias("merge_conflict_files"),
    )
    return by.withColumn("invalid_rate", F.round(F.col("invalid_files") / F.col("files"), 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return judge_files(load(spark, d, endings=list(G.LANGUAGE_OF))).filter(~F.col("is_valid")).select("file_id")


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    return judge_files(load(spark, d, endings=list(G.LANGUAGE_OF)))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(p4_files(spark, d))
