"""Provider records made into rows of the store, and rows of the store made into documents.

A value that a record must have and does not, or a date that is none, is an error that names entity and field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# What a review's state may be, in the provider's spelling.
REVIEW_STATES = "PENDING APPROVED CHANGES_REQUESTED COMMENTED DISMISSED".split()


def _fail(entity: str, field: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"cannot normalise {entity}: invalid {field} value "), F.coalesce(value.cast("string"), F.lit("null"))))


def required(entity: str, field: str, value: Column, kind: str = "string") -> Column:
    return F.when(value.isNotNull() & (value.cast("string") != ""), value).otherwise(_fail(entity, field, value).cast(kind))


def required_date(entity: str, field: str, value: Column) -> Column:
    """An ISO instant; null, empty or unreadable ones are an error."""
    t = F.try_to_timestamp(value)
    return F.when(t.isNotNull(), t).otherwise(_fail(entity, field, value).cast("timestamp"))


def optional_date(entity: str, field: str, value: Column) -> Column:
    """Null where there is none; an unreadable one is an error."""
    return F.when(value.isNull() | (value == ""), F.lit(None).cast("timestamp")).otherwise(required_date(entity, field, value))


def offset_date(value: Column) -> Column:
    """An ISO instant that names its offset; null for any other text."""
    return F.when(value.rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d(:\d\d(\.\d+)?)?([Zz]|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(F.upper(value)))


def percent_encode(c: Column) -> Column:
    """All but letters, digits and -_.!~*'() as percent signs and hexadecimal bytes."""
    e = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(code), F.lit(sign))
    return e


def provider_reference(provider: Column, kind: str, provider_id: Column) -> Column:
    return F.concat(F.lit("provider:"), percent_encode(provider), F.lit(f":{kind}:"), percent_encode(provider_id))


def review_state(state: Column) -> Column:
    s = F.upper(state)
    return F.when(s.isin(REVIEW_STATES), F.lower(s)).otherwise(_fail("review", "state", state).cast("string"))


def open_or_closed(entity: str, state: Column) -> Column:
    return F.when(state.isin("open", "closed"), state).otherwise(_fail(entity, "state", state).cast("string"))


def repositories(raw: DataFrame) -> DataFrame:
    """Of (provider, id, owner, name, html_url, default_branch, created_at, updated_at)."""
    return raw.select("provider", F.col("id").cast("string").alias("provider_id"), "owner", "name", F.col("html_url").alias("url"), "default_branch", required_date("repository", "created_at", F.col("created_at")).alias("created_at"), required_date("repository", "updated_at", F.col("updated_at")).alias("source_updated_at"))


def _common(entity: str) -> list[Column]:
    return [F.col("id").cast("string").alias("provider_id"), "body", F.col("user").alias("author"), required_date(entity, "created_at", F.col("created_at")).alias("created_at"), required_date(entity, "updated_at", F.col("updated_at")).alias("source_updated_at")]


def issues(raw: DataFrame) -> DataFrame:
    """Of (id, number, title, body, state, user, created_at, closed_at, updated_at)."""
    return raw.select(*_common("issue"), "number", "title", open_or_closed("issue", F.col("state")).alias("state"), optional_date("issue", "closed_at", F.col("closed_at")).alias("closed_at"))


def issue_comments(raw: DataFrame) -> DataFrame:
    """Of (id, issue_url, body, user, created_at, updated_at): the address must end in /issues/ and a number."""
    n = F.nullif(F.regexp_extract("issue_url", r"/issues/(\d+)$", 1), F.lit("")).cast("int")
    return raw.select(*_common("issue comment"), F.when(n.isNotNull(), n).otherwise(_fail("issue comment", "issue_url", F.col("issue_url")).cast("int")).alias("issue_number"))


def pull_requests(raw: DataFrame) -> DataFrame:
    """Of (id, number, title, body, state, user, base_ref, head_ref, created_at, merged_at, closed_at, updated_at)."""
    s = F.when(F.col("merged_at").isNotNull() & (F.col("merged_at") != ""), F.lit("merged")).otherwise(open_or_closed("pull request", F.col("state")))
    return raw.select(*_common("pull request"), "number", "title", s.alias("state"), F.col("base_ref").alias("base_branch"), F.col("head_ref").alias("head_branch"), optional_date("pull request", "merged_at", F.col("merged_at")).alias("merged_at"), optional_date("pull request", "closed_at", F.col("closed_at")).alias("closed_at"))


def reviews(raw: DataFrame) -> DataFrame:
    """Of (id, body, state, user, submitted_at)."""
    return raw.select(F.col("id").cast("string").alias("provider_id"), "body", F.col("user").alias("author"), review_state(F.col("state")).alias("state"), required_date("review", "submitted_at", F.col("submitted_at")).alias("created_at"))


def commits(raw: DataFrame) -> DataFrame:
    """Of (sha, message, author, author_email, author_date, committer_date): the author must have a name."""
    return raw.select("sha", "message", required("commit", "author.name", F.col("author")).alias("author"), F.nullif("author_email", F.lit("")).alias("author_email"), required_date("commit", "author.date", F.col("author_date")).alias("authored_at"), required_date("commit", "committer.date", F.col("committer_date")).alias("committed_at"))


# ---- documents
def sections(*parts: Column) -> Column:
    """Trimmed sections joined by blank lines, empty ones left out."""
    return F.concat_ws("\n\n", *[F.nullif(tx.trim(p), F.lit("")) for p in parts])


def heading(label: str, number: Column, title: Column | None = None) -> Column:
    h = F.concat(F.lit(label), F.coalesce(F.concat(F.lit(" #"), number.cast("string")), F.lit("")))
    return h if title is None else F.concat(h, F.coalesce(F.concat(F.lit(": "), F.nullif(title, F.lit(""))), F.lit("")))


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.nullif(value, F.lit("")))


def iso(t: Column) -> Column:
    """An instant as ISO text in UTC, to the millisecond."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


_DOCUMENT = ["repository_id", "source_type", "source_entity_id", "parent_source_type", "parent_source_entity_id", "source_version", "source_reference", "title", "text", "occurred_at", "available_at", "path", "commit_sha"]


def _document(df: DataFrame, **columns: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    return df.select(*[columns.get(c, null).alias(c) for c in _DOCUMENT])


def _provided(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """Documents of records with created_at and source_updated_at: the version is the later of these instants."""
    at = F.coalesce("source_updated_at", "created_at")
    return _document(df, repository_id=F.col("repository_id"), source_type=F.lit(kind), source_entity_id=F.col("id"), source_version=iso(at), source_reference=provider_reference(F.col("provider"), kind, F.col("provider_id")), occurred_at=F.col("created_at"), available_at=at, **columns)


def issue_documents(df: DataFrame) -> DataFrame:
    """Of issues with provider, repository_id and id."""
    return _provided(df, "issue", title=F.col("title"), text=sections(heading("Issue", F.col("number"), F.col("title")), _labelled("State", F.col("state")), _labelled("Author", F.col("author")), F.col("body")))


def comment_documents(df: DataFrame) -> DataFrame:
    """Of issue comments with their issue's id (issue_id) and number."""
    title = heading("Comment on issue", F.col("issue_number"))
    return _provided(df, "issue_comment", parent_source_type=F.lit("issue"), parent_source_entity_id=F.col("issue_id"), title=title, text=sections(title, _labelled("Author", F.col("author")), F.col("body")))


def pull_request_documents(df: DataFrame) -> DataFrame:
    branches = F.concat(F.lit("Branches: "), "head_branch", F.lit(" -> "), "base_branch")
    return _provided(df, "pull_request", title=F.col("title"), text=sections(heading("Pull request", F.col("number"), F.col("title")), _labelled("State", F.col("state")), branches, _labelled("Author", F.col("author")), F.col("body")))


def review_documents(df: DataFrame) -> DataFrame:
    """Of reviews with their pull request's id (pull_request_id) and number."""
    title = heading("Review on pull request", F.col("pull_request_number"))
    return _provided(df, "review", parent_source_type=F.lit("pull_request"), parent_source_entity_id=F.col("pull_request_id"), title=title, text=sections(title, _labelled("State", F.col("state")), _labelled("Author", F.col("author")), F.col("body")))


def commit_documents(df: DataFrame) -> DataFrame:
    """Of commits with repository_id and id: they occurred when authored and are available when committed."""
    first = tx.trim(F.substring_index("message", "\n", 1))
    return _document(df, repository_id=F.col("repository_id"), source_type=F.lit("commit"), source_entity_id=F.col("id"), source_version=F.col("sha"), source_reference=F.concat(F.lit("git:"), "sha"), title=F.coalesce(F.nullif(first, F.lit("")), F.col("sha")), text=sections(F.concat(F.lit("Commit "), "sha"), F.concat(F.lit("Author: "), "author"), F.col("message")), occurred_at=F.col("authored_at"), available_at=F.col("committed_at"), commit_sha=F.col("sha"))


def source_documents(df: DataFrame) -> DataFrame:
    """Of files with repository_id, id, path, content, commit_sha and committed_at."""
    return _document(df, repository_id=F.col("repository_id"), source_type=F.lit("source_code"), source_entity_id=F.col("id"), source_version=F.col("commit_sha"), source_reference=F.concat(F.lit("git:"), "commit_sha", F.lit(":"), "path"), title=F.col("path"), text=F.col("content"), occurred_at=F.col("committed_at"), available_at=F.col("committed_at"), path=F.col("path"), commit_sha=F.col("commit_sha"))


def document_union(*frames: DataFrame) -> DataFrame:
    """All documents of a memory, with their identity: kind, entity and version in a repository."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("id", tx.identity(F.lit("document_v1"), F.col("repository_id"), F.col("source_type"), F.col("source_entity_id"), F.col("source_version"))).withColumn("content_hash", F.sha2("text", 256))
