"""Paired experiments: attempts, outcomes, medians of differences, exact tests, and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_of


def latest_attempt(runs: DataFrame) -> DataFrame:
    """The last attempt of each task and condition, by retry number, then run id."""
    return first_of(runs, ["task_id", "condition"], [F.col("retry").desc(), F.col("run_id").desc()])


def paired(runs: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """One row a task with both conditions: <value>_a and <value>_b. Tasks that lack one are left out."""
    x = runs.filter(F.col("condition") == a).select("task_id", *[F.col(v).alias(f"{v}_a") for v in values])
    y = runs.filter(F.col("condition") == b).select("task_id", *[F.col(v).alias(f"{v}_b") for v in values])
    return x.join(y, "task_id")


def median_difference(value: str) -> Column:
    """The median of b - a; the mean of the middle two for an even number, null for none."""
    return F.median(F.col(f"{value}_b") - F.col(f"{value}_a"))


def outcomes(pairs: DataFrame, value: str = "passed", *more: Column) -> DataFrame:
    """One row: the four counts of a 2 by 2 table and the exact two-sided McNemar probability, and any more aggregates."""
    a, b = F.col(f"{value}_a"), F.col(f"{value}_b")
    t = pairs.agg(
        F.count_if(a & b).alias("both"),
        F.count_if(a & ~b).alias("only_a"),
        F.count_if(~a & b).alias("only_b"),
        F.count_if(~a & ~b).alias("neither"),
        *more,
    )
    return t.withColumn("p_value", mcnemar(F.col("only_a"), F.col("only_b")))


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided: twice the smaller binomial tail at one half over the discordant pairs, 1 at most and 1 for none."""
    n, k = only_a + only_b, F.least(only_a, only_b)

    def term(i: Column) -> Column:
        # C(n, i) / 2**n as a product that stays in range
        return F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.pow(F.lit(0.5), n.cast("double")), lambda acc, j: F.when(i >= j, acc * (n - j + 1) / j).otherwise(acc))

    tail = F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda acc, i: acc + term(i))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def pair_order(tasks: DataFrame, seed: str) -> DataFrame:
    """Tasks in the order of the SHA-256 of seed and id, and which condition comes first, by the parity of its first byte."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.col("task_id").cast("string")), 256)
    t = tasks.select("task_id", h.alias("h"))
    t = t.withColumn("first", F.when(F.conv(F.left("h", F.lit(2)), 16, 10).cast("int") % 2 == 0, "baseline").otherwise("treatment"))
    # tasks of an experiment are few: one ordered task is fine
    return t.withColumn("place", F.row_number().over(Window.orderBy("h", "task_id"))).drop("h")


# ---- event logs
# Commands by what they do.
READ = r"^(?:cat|head|tail|less|more|nl|sed\s+-n|bat)\b"
SEARCH = r"^(?:rg|grep|ag|ack|git\s+grep)\b"
DISCOVER = r"^(?:ls|find|fd|tree|git\s+ls-files)\b"


def command_class(command: Column) -> Column:
    c = F.regexp_replace(command, r"^\s+", "")
    return F.when(c.rlike(READ), "read").when(c.rlike(SEARCH), "search").when(c.rlike(DISCOVER), "discover").otherwise("other")


def command_paths(command: Column) -> Column:
    """The distinct repository paths a command names: words with an ending or a slash that are no options."""
    words = F.split(F.regexp_replace(command, r"[\"'`|;&()<>]", " "), r"\s+")
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^\./", "")), lambda w: w.rlike(r"^[\w@.-]+(?:/[\w@.-]+)*\.[A-Za-z]\w{0,9}$")))


def tool_metrics(events: DataFrame) -> DataFrame:
    """Per run: calls by class, distinct files, time of the first read, and the usage of the last completed turn.

    `events` has run_id, seq, elapsed_ms, type, command, usage (null where none).
    """
    e = events.withColumns({"class": F.when(F.col("command").isNotNull(), command_class(F.col("command"))), "files": F.when(F.col("command").isNotNull(), command_paths(F.col("command")))})
    return e.groupBy("run_id").agg(
        F.count("class").alias("calls"),
        *[F.count_if(F.col("class") == c).alias(f"{c}_calls") for c in ("read", "search", "discover")],
        F.size(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"),
        F.min(F.when(F.col("class") == "read", F.col("elapsed_ms"))).alias("first_read_ms"),
        F.max_by("usage", F.when(F.col("type") == "turn.completed", F.col("seq"))).alias("usage"),
    )


def relevance(runs: DataFrame) -> DataFrame:
    """Per run with arrays read, edited and relevant: recall of relevant files read, and files outside them."""
    r = runs.withColumns({"hit": F.array_intersect("read", "relevant"), "edited_hit": F.array_intersect("edited", "relevant"), "irrelevant": F.array_except("read", "relevant")})
    return r.select("run_id", F.coalesce(F.size("hit") / F.nullif(F.size("relevant"), F.lit(0)), F.lit(0.0)).alias("relevant_recall"), F.size("edited_hit").alias("relevant_edited"), F.size("irrelevant").alias("irrelevant_files"))


def artifact_drift(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose SHA-256 is not the manifest's, missing and unlisted ones: rows (path, expected, actual)."""
    a = files.select("path", F.sha2("content", 256).alias("actual"))
    j = manifest.select("path", F.col("sha256").alias("expected")).join(a, "path", "full")
    return j.filter(~F.col("expected").eqNullSafe(F.col("actual")))


def outcomes_by(pairs: DataFrame, category: str, value: str = "passed") -> DataFrame:
    """Pairs and passes of either condition by category."""
    return pairs.groupBy(category).agg(F.count("*").alias("pairs"), F.count_if(F.col(f"{value}_a")).alias("passed_a"), F.count_if(F.col(f"{value}_b")).alias("passed_b"))


# How a run ended, by what its last words say.
ENDINGS = [("timed_out", r"(?i)timed? ?out|deadline exceeded"), ("rate_limited", r"(?i)rate.?limit|too many requests|\b429\b"), ("unavailable", r"(?i)connection (?:refused|reset)|unavailable|\b50[234]\b")]


def completion(exit_code: Column, signal: Column, output: Column, completed_turns: Column) -> Column:
    """completed, timed_out, rate_limited, unavailable, killed, or failed; a clean exit without a completed turn is incomplete."""
    c = F.when((exit_code == 0) & (completed_turns > 0), "completed")
    for name, pattern in ENDINGS:
        c = c.when(F.coalesce(output, F.lit("")).rlike(pattern), name)
    return c.when(signal.isNotNull(), "killed").when(exit_code == 0, "incomplete").otherwise("failed")


def may_retry(ending: Column, retry: Column, most: int = 1) -> Column:
    """Runs that ended for reasons of the surroundings are repeated, at most so often."""
    return ending.isin("rate_limited", "unavailable", "killed") & (retry < most)


def patch_stats(diff: DataFrame) -> DataFrame:
    """Insertions, deletions and files of each run's changed lines (run_id, path, insertions, deletions); binary files have nulls."""
    return diff.groupBy("run_id").agg(F.coalesce(F.sum("insertions"), F.lit(0)).alias("insertions"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions"), F.countDistinct("path").alias("files"))


def treatment_calls(calls: DataFrame, later: DataFrame) -> DataFrame:
    """Per call of the treatment's tool: files it surfaced, relevant ones among them, and which of them the run opened or edited afterwards.

    `calls` has run_id, call_id, elapsed_ms and arrays surfaced and relevant; `later` run_id, path, elapsed_ms and
    action ('read' or 'edit').
    """
    f = calls.select("run_id", "call_id", "elapsed_ms", F.explode(F.array_distinct("surfaced")).alias("path"), "relevant").withColumn("is_relevant", F.array_contains("relevant", F.col("path")))
    l = later.select("run_id", "path", F.col("elapsed_ms").alias("__at"), "action")
    j = f.join(l, ["run_id", "path"], "left").withColumn("after", F.col("__at") > F.col("elapsed_ms"))
    j = j.groupBy("run_id", "call_id", "path", "is_relevant").agg(F.coalesce(F.max(F.col("after") & (F.col("action") == "read")), F.lit(False)).alias("opened"), F.coalesce(F.max(F.col("after") & (F.col("action") == "edit")), F.lit(False)).alias("edited"))
    return j.groupBy("run_id", "call_id").agg(F.count("*").alias("surfaced"), F.count_if("is_relevant").alias("relevant"), F.count_if("opened").alias("opened_later"), F.count_if("edited").alias("edited_later"))


def preflight(expected: DataFrame, repositories: DataFrame, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, files: DataFrame) -> DataFrame:
    """What a memory has against what was frozen: rows (repository_id, what, expected, actual) that differ.

    `expected` has repository_id, revision, documents, chunks, embeddings.
    """
    def n(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("repository_id").agg(F.count("*").alias(name))

    a = repositories.select(F.col("id").alias("repository_id")).join(files.groupBy("repository_id").agg(F.max("last_known_commit_sha").alias("revision")), "repository_id", "left")
    for df, name in ((documents, "documents"), (chunks, "chunks"), (embeddings, "embeddings")):
        a = a.join(n(df, name), "repository_id", "left")
    a = a.fillna(0, ["documents", "chunks", "embeddings"])
    cells = lambda d, name: d.select("repository_id", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias(name)) for c in ("revision", "documents", "chunks", "embeddings")])).alias("x")).select("repository_id", "x.what", f"x.{name}")
    return cells(expected, "expected").join(cells(a, "actual"), ["repository_id", "what"], "left").filter(~F.col("expected").eqNullSafe(F.col("actual")))
