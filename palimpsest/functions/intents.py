"""What a query is after: intents with confidence and evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

# The intents, in the order that breaks ties.
INTENTS = "implementation tests configuration documentation database_schema migration api_endpoint exact_symbol error_handling authentication authorization history_rationale general".split()

# Fixed values: (intent, confidence, evidence, case matters, words as a pattern without its word boundaries).
RULES = [
    ("tests", 1.0, "explicit test terminology", False, r"test|tests|tested|testing|spec|specs"),
    ("configuration", 0.95, "explicit configuration terminology", False, r"config|configuration|configure|configured|configuring|environment|settings?"),
    ("database_schema", 0.95, "explicit database or schema terminology", False, r"database|schema|model(?:ed|led|s)?|prisma|table|column|relation(?:ship)?s?"),
    ("database_schema", 0.85, "storage-location phrase", False, r"(?:stored|persisted)\b.{0,40}\b(?:database|db)"),
    ("migration", 1.0, "explicit migration terminology", False, r"migration|migrations|migrate|migrated"),
    ("api_endpoint", 0.9, "API or endpoint terminology", True, r"api|endpoint|route|router|request handler|webhook|graphql|rpc|rest|GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD"),
    ("error_handling", 0.9, "error-handling terminology", False, r"error|errors|exception|exceptions|failure|failures|fallback|retry|retries|handled|handling|mapped|mapping"),
    ("documentation", 0.95, "documentation terminology", False, r"documentation|docs|readme|guide|reference documentation|explain(?:ed|s|ing)?"),
    ("authentication", 0.9, "authentication terminology", False, r"authentication|authenticate|authenticated|login|log in|sign in|session|sessions|credential|credentials"),
    ("authorization", 0.9, "authorization terminology", False, r"authorization|authorize|authorized|permission|permissions|access control|role-based|rbac"),
    ("history_rationale", 0.95, "history or rationale phrase", False, r"why|rationale|history|historical|introduced|changed|removed|deprecated|commit|pull request|pr"),
    ("implementation", 1.0, "explicit implementation terminology", False, r"implement|implements|implemented|implementation|runtime|handler|functionality"),
    ("implementation", 0.65, "engineering flow phrase", False, r"how does|how is|trace|flow|from .{0,40} through"),
    ("implementation", 0.5, "code-location phrase", False, r"where (?:is|are|does|do)"),
]
# Shapes of queries that name a place in the code, tried in order.
FILE_SHAPE = r"(?i)^[^\s/\\]+\.[a-z][a-z0-9]{0,9}$"
PATH_SHAPE = r"^(?:\.?\.?[/\\])?[^\s]+[/\\][^\s]+$"
IDENTIFIER_SHAPE = r"^[$A-Z_a-z][$A-Za-z0-9_]*(?:(?:\.|::|#)[$A-Z_a-z][$A-Za-z0-9_]*)*$"
IDENTIFIER_MARK = r"^[A-Z]|^.+[A-Z]|[_$.:#]"

SIGNAL = "struct<intent:string,confidence:double,evidence:array<string>>"


def word_pattern(words: str, case: bool) -> str:
    """A rule's pattern for Java: ASCII word boundaries, which Java's own are not."""
    inner = words.replace(r"\b", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")
    return ("" if case else "(?i)") + rf"(?<![A-Za-z0-9_])(?:{inner})(?![A-Za-z0-9_])"


def navigation_evidence(q: Column) -> Column:
    return (
        F.when(q.rlike(FILE_SHAPE), F.lit("filename-shaped query"))
        .when(q.rlike(PATH_SHAPE), F.lit("path-shaped query"))
        .when(q.rlike(IDENTIFIER_SHAPE) & q.rlike(IDENTIFIER_MARK), F.lit("identifier-shaped query"))
    )


def signals(query: Column) -> Column:
    """The intents of a query, most confident first, then in the order of INTENTS; `general` where none fits.

    An intent that several rules find keeps the greatest confidence and all evidence.
    """
    q = trim(F.coalesce(query, F.lit("")))
    found = []
    nav = navigation_evidence(q)
    for k, intent in enumerate(INTENTS[:-1]):
        if intent == "exact_symbol":
            hits = [(1.0, nav)]
        else:
            hits = [(c, F.when(q.rlike(word_pattern(p, case)), F.lit(e))) for i, c, e, case, p in RULES if i == intent]
        evidence = F.array_compact(F.array(*[e for _, e in hits]))
        confidence = F.greatest(F.lit(0.0), *[F.when(e.isNotNull(), F.lit(c)).otherwise(F.lit(0.0)) for c, e in hits])
        found.append(F.when(F.size(evidence) > 0, F.struct((-confidence).alias("o"), F.lit(k).alias("k"), F.lit(intent).alias("intent"), confidence.alias("confidence"), evidence.alias("evidence"))))
    ordered = F.array_sort(F.array_compact(F.array(*found)))
    plain = F.transform(ordered, lambda s: F.struct(s["intent"].alias("intent"), s["confidence"].alias("confidence"), s["evidence"].alias("evidence")))
    fallback = F.array(F.struct(F.lit("general").alias("intent"), F.lit(0.25).alias("confidence"), F.array(F.lit("no specific engineering intent signal")).alias("evidence")))
    return F.when(F.size(ordered) > 0, plain).otherwise(fallback)
