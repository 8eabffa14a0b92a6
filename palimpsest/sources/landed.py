"""Readers of landed records: provider JSON, Git listings and histories, benchmark and result files, event lines.

Fetching over a network is left to a landing step; these read what it left, with the semantics of the calls.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.files import language
from ..functions.text import extension
from ..operators.ranking import rank_by


# ---- provider records
def list_issues(raw: DataFrame, limit: int, since: Column | None = None) -> DataFrame:
    """Issues by last update, newest first, without those that are pull requests."""
    d = raw.filter(F.col("pull_request").isNull()) if "pull_request" in raw.columns else raw
    d = d.filter(F.col("updated_at") >= since) if since is not None else d
    return d.orderBy(F.col("updated_at").desc(), "id").limit(limit)


def list_pull_requests(raw: DataFrame, limit: int, since: Column | None = None) -> DataFrame:
    d = raw.filter(F.col("updated_at") >= since) if since is not None else raw
    return d.orderBy(F.col("updated_at").desc(), "id").limit(limit)


def list_children(raw: DataFrame, parent: str, limit: int, order: list[str]) -> DataFrame:
    """Files or reviews of pull requests: at most `limit` a parent, in page order."""
    return rank_by(raw, [parent], [F.col(c) for c in order], "__page", limit).drop("__page")


def list_comments(raw: DataFrame, issues: DataFrame, limit: int) -> DataFrame:
    """Comments of the issues in their order (number, place), at most `limit` over all."""
    j = raw.join(issues.select("number", "place"), "number")
    return j.orderBy("place", "created_at", "id").limit(limit).drop("place")


def repository_address(url: Column, host: str | None = None) -> Column:
    """struct(owner, name) of an https address of two segments on the host, or on any where none is named; null for any other.

    Credentials, queries and fragments make an address unusable; a trailing .git is left off.
    """
    m = r"^https://(?![^/]*@)" + (re.escape(host) if host else "[a-z0-9.-]+") + r"/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"
    return F.when(url.rlike(m), F.struct(F.regexp_extract(url, m, 1).alias("owner"), F.regexp_extract(url, m, 2).alias("name")))


# ---- Git
def read_tree(spark: SparkSession, root: str, revision: str) -> DataFrame:
    """The files of a landed tree with size, language and ending; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    # whatever the store, a path is its address, the root, and the file's place below it
    bare = re.sub(r"^[A-Za-z0-9]+:(//[^/]*)?", "", root.rstrip("/"))
    below = bare if bare.startswith("/") else os.path.abspath(bare)
    d = d.withColumn("path", F.regexp_replace("path", rf"^[A-Za-z0-9]+:(?://[^/]*)?\Q{below}\E/", "")).filter(~F.col("path").startswith(".git/"))
    return d.select("path", F.col("length").alias("size"), language(F.col("path")).alias("language"), F.nullif(F.substring(extension(F.col("path")), 2, 99), F.lit("")).alias("extension"), F.lit(revision).alias("revision"))


def read_files(spark: SparkSession, root: str, maximum: int = 10 * 1024 * 1024) -> DataFrame:
    """Contents of the files within a size; the size is checked before any byte is read (the filter is pushed into the scan)."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return d.filter(F.col("length") <= maximum).select("path", "length", "content")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a log landed with record separators (0x1E) and fields cut by NUL: sha, author, e-mail, both dates, subject, body."""
    d = spark.read.option("lineSep", "\x1e").text(path).select(F.split(F.regexp_replace("value", r"^\n", ""), "\x00").alias("f")).filter(F.size("f") >= 7)
    message = F.concat_ws("\n\n", F.element_at("f", 6), F.nullif(F.regexp_replace(F.element_at("f", 7), r"^\s+|\s+$", ""), F.lit("")))
    return d.select(F.element_at("f", 1).alias("sha"), F.element_at("f", 2).alias("author"), F.nullif(F.element_at("f", 3), F.lit("")).alias("author_email"), F.to_timestamp(F.element_at("f", 4)).alias("authored_at"), F.to_timestamp(F.element_at("f", 5)).alias("committed_at"), message.alias("message"))


def is_safe_path(path: Column) -> Column:
    """No absolute path, no leading dash, no NUL and no way up."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"^[/\\-]|\x00|(^|[/\\])\.\.([/\\]|$)|^[A-Za-z]:")


# ---- JSON
def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


_TARGET = "struct<path:string,sourceType:string,sourceReference:string,symbolName:string,grade:int>"


def benchmark_schema() -> str:
    return (
        "version int, name string, split string, cutoffs array<int>,"
        f" cases array<struct<id:string,query:string,repositoryId:string,before:timestamp,category:string,difficulty:string,tags:array<string>,relevant:array<{_TARGET}>>>"
    )


def read_benchmark(spark: SparkSession, path: str, roots: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cases, targets) of a benchmark file: an absolute path, else the first root that has it; an error names all attempts."""
    tried = [path] if os.path.isabs(path) or "://" in path else [os.path.join(r, path) for r in (roots or [os.getcwd()])]
    found = next((p for p in tried if exists(spark, p)), None)
    if found is None:
        raise FileNotFoundError("no benchmark at " + ", ".join(tried))
    b = spark.read.schema(benchmark_schema()).option("multiLine", "true").json(found)
    cutoffs = F.array_sort(F.array_distinct(F.coalesce("cutoffs", F.array(F.lit(1), F.lit(3), F.lit(5), F.lit(10)))))
    c = b.select(F.posexplode("cases").alias("place", "c"), cutoffs.alias("cutoffs"))
    cases = c.select(F.col("c.id").alias("case_id"), F.col("c.query").alias("query"), F.col("c.repositoryId").alias("repository_id"), F.col("c.before").alias("cutoff"), F.col("c.category").alias("category"), "cutoffs")
    targets = c.select(F.col("c.id").alias("case_id"), F.posexplode("c.relevant").alias("target_id", "t"))
    targets = targets.select("case_id", "target_id", F.coalesce("t.grade", F.lit(1)).alias("grade"), F.col("t.path").alias("t_path"), F.col("t.sourceType").alias("t_source_type"), F.col("t.sourceReference").alias("t_source_reference"), F.col("t.symbolName").alias("t_symbol_name"))
    return cases, targets


def corpus_faults(cases: DataFrame, targets: DataFrame) -> DataFrame:
    """What is wrong with a benchmark: rows (case_id, fault); none for a good one."""
    twice = cases.groupBy("case_id").count().filter("count > 1").select("case_id", F.lit("repeated case id").alias("fault"))
    empty = cases.filter("query is null or trim(query) = ''").select("case_id", F.lit("empty query").alias("fault"))
    same = targets.groupBy("case_id", "t_path", "t_source_type", "t_source_reference", "t_symbol_name").count().filter("count > 1").select("case_id", F.lit("repeated selector").alias("fault"))
    bare = targets.filter("coalesce(t_path, t_source_type, t_source_reference, t_symbol_name) is null").select("case_id", F.lit("selector without fields").alias("fault"))
    grade = targets.filter("grade not between 1 and 3").select("case_id", F.lit("grade out of range").alias("fault"))
    return twice.union(empty).union(same).union(bare).union(grade)


def read_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All result.json files under a folder."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "result.json").json(root)


def read_events(lines: DataFrame) -> DataFrame:
    """Agent events from text lines (value): unparseable lines are dropped. Columns: receivedAt, elapsedMs, type, item, command, usage, event."""
    e = F.from_json("value", "receivedAt timestamp, elapsedMs bigint, event string", {"mode": "PERMISSIVE"})
    d = lines.withColumn("e", e).filter("e.event is not null")
    g = lambda p: F.get_json_object("e.event", p)
    return d.select("e.receivedAt", "e.elapsedMs", g("$.type").alias("type"), g("$.item.type").alias("item"), g("$.item.command").alias("command"), g("$.usage").alias("usage"), F.col("e.event").alias("event"))


def health(spark: SparkSession, **probes) -> DataFrame:
    """One row a probe: (name, ok, detail). The session is probed with a query of its own; each probe stands alone."""
    rows = []
    for name, probe in {"session": lambda: spark.sql("select 1").collect(), **probes}.items():
        try:
            probe()
            rows.append((name, True, None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, False, f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(rows, "name string, ok boolean, detail string")


def with_place(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of a short list numbered in an order: a page of issues, say. The numbering is one task, so the list must be bounded."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))
