"""Records, jobs, relationships, assessment, requests, sinks and provider calls on small cases."""

import io
import json
import math
import random
import time
from datetime import datetime

import numpy
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest import __main__ as cli
from palimpsest import sinks
from palimpsest.functions import stem
from palimpsest.operators import assess, chunking, edges, experiment, memory, pack, records, requests, search, upsert
from palimpsest.sources import landed, providers

T = "timestamp"


def _at(day: str) -> datetime:
    return datetime.fromisoformat(day)


def _rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# ---- records
def test_provider_records(spark):
    raw = spark.createDataFrame([(7, 3, "t", None, "open", "me", "2024-01-02T03:04:05Z", None, "2024-01-03T00:00:00+01:00")], "id long, number int, title string, body string, state string, user string, created_at string, closed_at string, updated_at string")
    r = records.issues(raw).first()
    assert r.provider_id == "7" and r.closed_at is None and str(r.source_updated_at) == "2024-01-02 23:00:00"
    for bad in (raw.withColumn("state", F.lit("merged")), raw.withColumn("created_at", F.lit("soon")), raw.withColumn("updated_at", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="cannot normalise issue"):
            records.issues(bad).collect()
    c = raw.withColumn("issue_url", F.lit("https://h/o/r/issues/12"))
    assert records.issue_comments(c).first().issue_number == 12
    with pytest.raises(Exception, match="issue_url"):
        records.issue_comments(raw.withColumn("issue_url", F.lit("https://h/o/r/pull/12"))).collect()
    p = raw.withColumns({"merged_at": F.lit("2024-02-01T00:00:00Z"), "base_ref": F.lit("main"), "head_ref": F.lit("x")})
    assert records.pull_requests(p).first().state == "merged"
    v = spark.createDataFrame([(1, "b", "changes_requested", None, "2024-01-01T00:00:00Z")], "id long, body string, state string, user string, submitted_at string")
    assert records.reviews(v).first().state == "changes_requested"
    with pytest.raises(Exception, match="review"):
        records.reviews(v.withColumn("state", F.lit("liked"))).collect()
    k = spark.createDataFrame([("s", "m", None, "", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z")], "sha string, message string, author string, author_email string, author_date string, committer_date string")
    with pytest.raises(Exception, match="author.name"):
        records.commits(k).collect()
    d = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("x",), (None,)], "v string")
    assert [r[0] is not None for r in d.select(records.offset_date(F.col("v"))).collect()] == [True, False, False, False]


def test_documents_of_records(spark):
    base = dict(repository_id="r", id="e", provider="my host", provider_id="1/2", created_at="2024-01-01", source_updated_at=None, number=4, title="Slow", body="  text ", state="open", author=None)
    df = spark.createDataFrame(pd.DataFrame([base])).withColumns({"created_at": F.to_timestamp("created_at"), "source_updated_at": F.lit(None).cast(T), "author": F.lit(None).cast("string")})
    r = records.issue_documents(df).first()
    assert r.text == "Issue #4: Slow\n\nState: open\n\ntext" and r.source_reference == "provider:my%20host:issue:1%2F2" and r.source_version == "2024-01-01T00:00:00.000Z" and r.available_at == r.occurred_at
    p = records.pull_request_documents(df.withColumns({"base_branch": F.lit("main"), "head_branch": F.lit("x"), "author": F.lit("me")})).first()
    assert p.text == "Pull request #4: Slow\n\nState: open\n\nBranches: x -> main\n\nAuthor: me\n\ntext"
    c = records.comment_documents(df.withColumns({"issue_id": F.lit("i"), "issue_number": F.lit(None).cast("int")})).first()
    assert c.title == "Comment on issue" and c.parent_source_type == "issue" and c.text == "Comment on issue\n\ntext"
    k = spark.createDataFrame([("r", "e", "abc", "\nfirst\nsecond", "me", None, None)], "repository_id string, id string, sha string, message string, author string, authored_at timestamp, committed_at timestamp")
    r = records.commit_documents(k).first()
    assert r.title == "abc" and r.text == "Commit abc\n\nAuthor: me\n\nfirst\nsecond" and r.source_reference == "git:abc"
    s = spark.createDataFrame([("r", "f", "a/b.ts", "x", "abc", None)], "repository_id string, id string, path string, content string, commit_sha string, committed_at timestamp")
    u = records.document_union(records.issue_documents(df), records.commit_documents(k), records.source_documents(s))
    assert u.count() == 3 and u.select("id").distinct().count() == 3 and u.filter("path = 'a/b.ts'").first().source_reference == "git:abc:a/b.ts"


# ---- persisting
_V = "id string, repository_id string, source_type string, source_entity_id string, source_version string, content_hash string, available_at string, superseded_at string"


def _v(spark, *rows):
    return spark.createDataFrame([(f"{e}{v}", "r", "issue", e, v, h, a, None) for e, v, h, a in rows], _V).withColumns({c: F.to_timestamp(c) for c in ("available_at", "superseded_at")})


def test_persisting_twice_changes_nothing(spark):
    old = memory.persist_documents(_v(spark).limit(0), _v(spark, ("a", "1", "x", "2024-01-01"), ("a", "2", "y", "2024-01-03"), ("b", "1", "z", "2024-01-01")))
    assert {(r.id, str(r.superseded_at)) for r in old.collect()} == {("a1", "2024-01-03 00:00:00"), ("a2", "None"), ("b1", "None")}
    new = _v(spark, ("a", "1b", "w", "2024-01-02"), ("a", "2", "y2", "2024-01-03"), ("a", "3", "q", "2024-01-03"))
    one = memory.persist_documents(old, new)
    # a version between two closes the earlier one sooner; versions of the same instant do not end each other
    assert {(r.id, r.content_hash, str(r.superseded_at)[:10]) for r in one.collect()} == {("a1", "x", "2024-01-02"), ("a1b", "w", "2024-01-03"), ("a2", "y2", "None"), ("a3", "q", "None"), ("b1", "z", "None")}
    assert _rows(memory.persist_documents(one, new), *one.columns) == _rows(one, *one.columns)


def test_chunks_relationships_and_reconciling(spark):
    ch = spark.createDataFrame([("c1", "a", 0, "h"), ("c2", "a", 1, "h"), ("c3", "b", 0, "h"), ("c4", "gone", 0, "h")], "id string, document_id string, chunk_index int, content_hash string")
    docs = spark.createDataFrame([("a",), ("b",)], "id string")
    new = spark.createDataFrame([("n1", "a", 0, "k")], ch.schema)
    assert _rows(memory.replace_chunks(ch, docs, new), "id") == [("c3",), ("n1",)]
    r = spark.createDataFrame([("1", "r", 1), ("2", "r", 1), ("3", "s", 1)], "id string, repository_id string, v int")
    assert _rows(memory.persist_relationships(r, spark.createDataFrame([("2", "r", 2), ("2", "r", 2)], r.schema)), "id", "v") == [("2", 2), ("3", 1)]
    d = spark.createDataFrame([("a", "r", "source_code", "x.ts"), ("b", "r", "source_code", "y.ts"), ("i", "r", "issue", None)], "id string, repository_id string, source_type string, path string")
    e = spark.createDataFrame([("c1",), ("c1",), ("c3",)], "chunk_id string")
    n, left, kept, emb = memory.reconcile(d, ch, e, spark.createDataFrame([("r", "y.ts")], "repository_id string, path string"))
    assert _rows(n, "documents", "chunks", "embeddings") == [(1, 2, 2)]  # both embeddings of a chunk count
    assert _rows(left, "id") == [("b",), ("i",)] and _rows(kept, "id") == [("c3",), ("c4",)] and _rows(emb, "chunk_id") == [("c3",)]


def test_upserts_return_and_merge(spark):
    pr = spark.createDataFrame([("i1", "r", "p1", 5, "2024"), ("i2", "r", "p2", None, None)], "id string, repository_id string, provider_id string, number int, deleted_at string")
    new = spark.createDataFrame([("i1", "r", "p1", 6), ("i2", "r", "p2", None)], "id string, repository_id string, provider_id string, number int")
    snap = upsert.upsert(pr, new, ["repository_id", "provider_id"], [F.col("id")])
    assert _rows(snap, "id", "number", "deleted_at") == [("i1", 6, None), ("i2", None, None)]
    assert _rows(upsert.returning(snap, new, ["repository_id", "provider_id"], ["id", "number"]), "id", "number") == [("i1", 6)]
    have = spark.createDataFrame([("x", "h", "1", "o", "n", "2024-01-01")], "id string, provider string, provider_id string, owner string, name string, source_updated_at string")
    both = spark.createDataFrame([("y", "h", "1", "o", "m", "2024-01-02"), ("z", "h", None, "o", "n", "2024-01-03")], have.schema)
    assert _rows(upsert.upsert_repository(have, both), "id", "name") == [("x", "n")]


def test_stages_and_embedding(spark):
    s = memory.Stages()
    with s.stage("read"):
        pass
    with pytest.raises(memory.StageError, match="stage write failed"), s.stage("write"):
        raise ValueError("disk")
    assert [(e["stage"], e["event"]) for e in s.events] == [("read", "started"), ("read", "completed"), ("write", "started"), ("write", "failed")]
    p = providers.embedder({"EMBEDDING_DIMENSIONS": "8"}, None)
    chunks = spark.createDataFrame([("c1", "r", "one two", "h1"), ("c2", "r", None, "h2"), ("c3", "r", "x", "h3")], "chunk_id string, repository_id string, content string, content_hash string")
    have = spark.createDataFrame([("c3", "r", p.name, p.model, 8, "h3")], "chunk_id string, repository_id string, provider string, model string, dimensions int, content_hash string")
    got = memory.embed_stale(chunks, have, p, 2)
    assert _rows(got, "chunk_id") == [("c1",), ("c2",)]
    assert memory.embed_stale(chunks, got.select(*have.columns).union(have), p).count() == 0
    for wrong in (lambda t: [], lambda t: [[1.0]] * len(t), lambda t: [[math.nan] * 8] * len(t)):
        with pytest.raises(ValueError):
            memory.checked(memory.Embedder("x", "m", 8, wrong), ["a"])


# ---- relationships
def test_edges(spark):
    d = spark.createDataFrame([("A", "r", "src/a.ts", "s1", "2024-01-01"), ("B", "r", "src/lib/b.ts", "s1", "2024-01-03"), ("C", "r", "pkg/c/index.ts", "s1", "2024-01-02"), ("D", "r", "base/d.js", "s1", "2024-01-01"), ("T", "r", "tsconfig.json", "s1", "2024-01-05"), ("X", "other", "src/lib/b.ts", "s1", "2024-01-01")], "id string, repository_id string, path string, commit_sha string, available_at string").withColumn("available_at", F.to_timestamp("available_at"))
    code = "import { one, two as deux } from './lib/b';\nimport type { T } from '@pkg/c';\nimport x from 'd.js';\nimport fs from 'node:fs';\nexport * from './gone';\nimport './lib/b';"
    b = chunking.extract_imports(spark.createDataFrame([("A", code, "src/a.ts")], "id string, text string, path string"))
    symbols = spark.createDataFrame([("B", "s1", "one", "function", None, 3, 5), ("B", "s1", "one", "function", None, 6, 9), ("B", "s2", "two", "class", None, 1, 2), ("B", "s3", "two", "class", None, 11, 12)], "document_id string, symbol_id string, symbol_name string, symbol_kind string, parent_symbol string, start_line int, end_line int")
    maps = spark.createDataFrame([("r", "tsconfig.json", "@pkg/*", "nowhere/*", 0), ("r", "tsconfig.json", "@pkg/*", "pkg/*", 1)], "repository_id string, config string, pattern string, target string, place int")
    bases = spark.createDataFrame([("r", "tsconfig.json", "base")], "repository_id string, config string, base string")
    rel, counts = edges.build(b, d, symbols, maps, bases)
    got = {(r.imported_name, r.target_path, r.resolution, r.module_resolution_kind, str(r.available_at)[:10]) for r in rel.collect()}
    assert got == {("one", "src/lib/b.ts", "exact_symbol", "relative", "2024-01-03"), ("two", "src/lib/b.ts", "exact_module", "relative", "2024-01-03"), ("T", "pkg/c/index.ts", "exact_module", "path_alias", "2024-01-05"), ("default", "base/d.js", "exact_module", "base_url", "2024-01-05"), (None, "src/lib/b.ts", "exact_module", "relative", "2024-01-03")}
    one = rel.filter("imported_name = 'one'").first()
    assert (one.target_symbol, one.target_start_line, one.target_end_line, one.target_symbol_kind) == ("one", 3, 9, "function") and "(relative, exact_symbol)" in one.reason
    n = counts.first()
    assert (n.parsed, n.external, n.relative, n.path_alias, n.base_url, n.unresolved_local, n.relationships, n.exact_symbol, n.imports) == (7, 1, 4, 1, 1, 1, 5, 1, 5)
    assert rel.select("id").distinct().count() == 5 and edges.canonical(rel).first().source_start_line == 1
    assert edges.build(b.limit(0), d, symbols)[0].count() == 0


def test_symbols_with_members():
    ts = "export class A<T> extends B {\n  private x: number = 1;\n  static async go(a: string): Promise<void> {\n    if (a) {\n      this.x;\n    }\n  }\n\n  get y(): number { return 1; }\n}\nfunction f(a) {\n  return a;\n}\n"
    state, got = chunking.symbols_of(ts, "TypeScript")
    assert state == "parsed" and [x[:5] for x in got] == [("A", "class", None, 1, 10), ("x", "property", "A", 2, 2), ("go", "method", "A", 3, 7), ("y", "method", "A", 9, 9), ("f", "function", None, 11, 13)]
    assert got[2][5] == "static async go(a: string): Promise<void>"
    py = "class C:\n    z = 1\n\n    def m(self):\n        return 2\n\ndef g():\n    pass\n"
    assert [x[:5] for x in chunking.symbols_of(py, "Python")[1]] == [("C", "class", None, 1, 5), ("z", "property", "C", 2, 2), ("m", "method", "C", 4, 5), ("g", "function", None, 7, 8)]
    assert [x[:3] for x in chunking.symbols_of("package a\nfunc (s *Store) Get() int {\n\treturn 1\n}\n", "Go")[1]] == [("Get", "method", "Store")]
    assert chunking.symbols_of("x", "Ruby") == ("unsupported", []) and chunking.symbols_of("class A {", "TypeScript")[0] == "failed"
    assert len(chunking.symbols_of("function f(" + "a, " * 400 + "b) {\n}", "JavaScript")[1][0][5]) == 500


# ---- assessment
def _evidence(spark):
    rel = "array<struct<imported_name:string,target_symbol:string,resolution:string>>"
    rows = [("k", 1, "a.ts", "source_code", "x", "f", 1, 3, "abc", None), ("k", 2, "b.ts", "source_code", "y", "g", 1, 2, "de", [("g", "g", "exact_symbol")]), ("k", 3, "c.ts", "source_code", "z", None, 1, 2, "de", [("h", "h", "exact_module")]), ("k", 4, "a.ts", "source_code", "x", "f", 2, 5, "fgh", [])]
    return spark.createDataFrame(rows, f"case_id string, item int, path string, source_type string, source_reference string, symbol_name string, start_line int, end_line int, content string, relationships {rel}")


_TARGETS = "case_id string, target_id int, need string, t_path string, t_source_type string, t_source_reference string, t_symbol_name string, grade int"


def test_case_metrics(spark):
    t = spark.createDataFrame([("k", 1, "required", "a.ts", None, None, None, 1), ("k", 2, "required", None, None, "nope", None, 1), ("k", 3, "supporting", "b.ts", None, None, "g", 1)], _TARGETS)
    cases = spark.createDataFrame([("k", "x"), ("empty", "y")], "case_id string, category string")
    m = {r.case_id: r for r in assess.case_metrics(cases, _evidence(spark), t, 20).collect()}
    k = m["k"]
    assert (k.required_recall, k.supporting_recall, k.complete, k.precision, k.noise) == (0.5, 1.0, 0, 0.75, 0.25)
    assert (k.duplicate_ratio, k.budget_use, k.distinct_relevant_files, k.items, k.characters) == (0.5, 0.5, 2, 4, 10)
    assert (k.relationship_items, k.relationship_labelled, k.symbol_bearing, k.exact_symbol, k.module_only, k.relationship_precision, k.exact_target_rate) == (2, 1, 2, 1, 1, 0.5, 0.5)
    assert m["empty"].items == 0 and m["empty"].supporting_recall == 1.0 and m["empty"].precision == 0
    s = {r.category: r for r in assess.summarise(assess.case_metrics(cases, _evidence(spark), t, 20).join(cases, "case_id"), "category").collect()}
    assert s[None].cases == 2 and s[None].relationship_precision == 0.5 and s["x"].precision == 0.75
    assert [r.case_id for r in assess.failure_report(assess.case_metrics(cases, _evidence(spark), t, 20)).collect()] == ["empty", "k"]


def test_outcomes_and_effects(spark):
    c = _evidence(spark).withColumnRenamed("item", "rank").withColumns({"relationship_rank": F.when(F.col("rank") >= 3, F.col("rank")), "direct": F.col("rank") != 3})
    t = spark.createDataFrame([("k", 1, "", "a.ts", None, None, None, 1), ("k", 2, "", "b.ts", None, None, "g", 1), ("k", 3, "", "b.ts", None, None, "other", 1), ("k", 4, "", "q.ts", None, None, None, 1), ("k", 5, "", "c.ts", None, None, None, 1)], _TARGETS)
    got = {r.target_id: (r.outcome, r.final_rank, r.candidate_rank) for r in assess.outcomes(t, c.filter("rank = 1"), c).collect()}
    assert got == {1: ("successfully_returned", 1, 1), 2: ("reranked_below_cutoff", None, 2), 3: ("wrong_chunk_from_target_file", None, None), 4: ("absent_from_candidate_pool", None, None), 5: ("reranked_below_cutoff", None, 3)}
    e = assess.relationship_effect(t, c).first()
    assert (e.relationship_candidates, e.relationship_only, e.relationship_false, e.recovered) == (2, 1, 0, 1)
    x = spark.createDataFrame([(9, 2, 1, False), (2, 9, None, False), (2, 2, None, False), (9, 9, None, False), (None, None, None, True), (None, None, None, False), (1, 1, 1, False)], "b int, c int, f int, i boolean")
    want = "role_prior_promoted_candidate role_prior_demoted_candidate reranker_reversed_useful_order compatible_candidate_below_cutoff wrong_chunk_from_target_file candidate_missing unchanged".split()
    assert [r[0] for r in x.select(assess.role_effect(F.col("b"), F.col("c"), F.col("f"), F.col("i"), 5)).collect()] == want
    roles = spark.createDataFrame([("source_code", "a/b.test.ts"), (None, "a/x.sql"), ("issue", None), (None, None)], "t string, p string").select(assess.target_role(F.col("t"), F.col("p"))).collect()
    assert [r[0] for r in roles][0] == "unit_test" and [r[0] for r in roles][2:] == ["development_history", "unknown"]


def test_isolation(spark):
    q = spark.createDataFrame([("k", "r", "2024-01-02")], "case_id string, repository_id string, cutoff string").withColumn("cutoff", F.to_timestamp("cutoff"))
    e = lambda r, t: spark.createDataFrame([("k", r, t)], "case_id string, repository_id string, available_at string").withColumn("available_at", F.to_timestamp("available_at"))
    assert assess.isolated(e("r", "2024-01-02"), q).count() == 1
    for bad in (e("s", "2024-01-01"), e("r", "2024-01-03")):
        with pytest.raises(Exception, match="isolation"):
            assess.isolated(bad, q).collect()


# ---- requests
R = "123e4567-e89b-12d3-a456-426614174000"


def test_requests():
    s = requests.normalised(R, "  q ")
    assert s.query == "q" and s.limit == 10 and s.cutoff.tzinfo is not None
    for code, args in {"invalid_repository": ("x", "q"), "invalid_query": (R, " "), "query_too_long": (R, "q" * 4001), "invalid_limit": (R, "q", 101), "invalid_cutoff": (R, "q", 5, "now")}.items():
        with pytest.raises(requests.RequestError) as e:
            requests.normalised(*args)
        assert e.value.code == code
    for bad in (255, 100_001, True, 3.5):
        with pytest.raises(requests.RequestError):
            requests.budget(bad)
    with pytest.raises(ValueError):
        requests.positive(limit=0)
    assert requests.sanitised('bad "key" abcdefghijklmnopqrstuvwxyz012 my text', "my text") == "bad [quoted] [token] [input]"


def test_ready(spark):
    c = spark.createDataFrame([("a", None, 5, True), ("b", "2024", 5, True), ("c", None, -1, True), ("d", None, 5, False)], "repository_id string, deleted_at string, indexed_us long, ready boolean")
    assert requests.ready(c, "a")["ready"]
    for r, code in (("b", "deleted_repository"), ("c", "not_indexed"), ("d", "embeddings_missing"), ("z", "unknown_repository")):
        with pytest.raises(requests.RequestError, match=code):
            requests.ready(c, r)


def test_reranking(spark):
    pool = spark.createDataFrame([(1, "a", 1, "retry queue"), (1, "b", 2, "other"), (1, "c", 3, "queue"), (2, "d", 1, "x")], "query_id int, chunk_id string, rrf_rank int, rerank_text string")
    q = spark.createDataFrame([(1, "queue other things"), (2, "x")], "query_id int, query string")
    got = requests.reranked(pool, q, requests.overlap_reranker, 2, 3)
    assert _rows(got, "query_id", "chunk_id", "final_rank") == [(1, "a", 1), (1, "b", 2), (2, "d", 1)]  # equal scores keep their order
    for bad in (lambda q, t: [1.0], lambda q, t: [math.inf] * len(t)):
        with pytest.raises(Exception, match="finite score"):
            requests.reranked(pool, q, bad, 2, 3).collect()
    with pytest.raises(ValueError):
        requests.reranked(pool, q, requests.overlap_reranker, 4, 3)
    with pytest.raises(Exception, match="distinct ids"):
        requests.reranked(pool.union(pool), q, requests.overlap_reranker, 1, 9).collect()
    assert _rows(requests.diagnostics(pool), "query_id", "candidates", "bytes") == [(1, 3, 21), (2, 1, 1)]


# ---- packs
def _candidates(spark, intents):
    base = dict(role="production_implementation", source_reference="s", symbol_id=None, symbol_kind=None, symbol_part=None, start_line=None, end_line=None, relation=None, reason=None, priority=None)
    rows = [dict(base, query_id="q", chunk_id=c, origin=o, rank=r, exact=False, path=p, symbol_name=None, content=t) | more for c, o, r, p, t, more in [("a", "primary", 1, "a.ts", "aaa", {}), ("b", "primary", 2, "a.ts", "bbb", {}), ("c", "primary", 3, "c.ts", "aaa", {}), ("d", "primary", 4, "d.ts", "ddd", {}), ("l", "local", 1, "a.ts", "lll", {"reason": "parent_symbol", "priority": 11}), ("r", "relation", 1, "e.ts", "rrr", {"relation": "imports"}), ("x", "relation", 2, "f.ts", "x" * 50, {"relation": "imports"})]]
    schema = "query_id string, chunk_id string, origin string, rank int, exact boolean, path string, symbol_name string, content string, " + ", ".join(f"{k} {'int' if k in ('symbol_part', 'start_line', 'end_line', 'priority') else 'string'}" for k in base)
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema), spark.createDataFrame([("q", intents)], "query_id string, intents array<string>")


def test_pack_decisions_and_history(spark):
    c, i = _candidates(spark, ["implementation"])
    assert [r.chunk_id for r in pack.build(c, i, 40).orderBy("item").collect()] == ["a", "d", "l", "r"]
    # b repeats the path of a, c its content; what does not fit is passed over
    log = {(r.chunk_id, r.action) for r in pack.decisions(c, i, 40).collect()}
    assert {("a", "selected"), ("b", "rejected_anchor"), ("c", "rejected_anchor"), ("x", "rejected_budget"), ("r", "included")} <= log
    assert [(r.chunk_id, r.anchor) for r in pack.chosen(c, i).orderBy("anchor").collect()] == [("a", 1), ("d", 2)]
    c, i = _candidates(spark, ["history_rationale"])
    assert {r.chunk_id for r in pack.build(c, i, 40).collect()} == {"a", "d"}


def test_command_line_takes_only_what_fits():
    p = cli.parser()
    a = p.parse_args(["context", "d", "--repository", R, "--query", "q", "--budget", "300"])
    assert a.budget == 300 and a.format == "json" and p.parse_args(["search", "d", "--repository", R, "--query", "q"]).limit == 10
    for bad in (["search", "d", "--query", "q"], ["search", "d", "--repository", R, "--query", "q", "--budget", "300"], ["catalogue", "d", "--limit", "3"], ["nothing", "d"]):
        with pytest.raises(SystemExit):
            p.parse_args(bad)


# ---- lexical search
def test_stems_and_cover_density(spark):
    assert [stem.stem(w) for w in "running configuration queues generously dying relational".split()] == ["run", "configur", "queue", "generous", "die", "relat"]
    cols = "chunk_id string, repository_id string, path string, symbol_name string, content string, parent_symbol string, source_type string, source_reference string, language string, symbol_kind string, document_id string, available_at timestamp, superseded_at timestamp, indexed_at timestamp"
    at = _at("2024-01-01")
    row = lambda i, path, symbol, text, idx=at, until=None: (i, "r", path, symbol, text, None, "source_code", "ref", None, None, "d", at, until, idx)
    c = spark.createDataFrame([row("a", "src/handler.ts", None, "it was handled while handling errors"), row("b", None, "handle", ""), row("c", None, None, "the and of"), row("d", None, None, "handled", until=at), row("e", None, None, "handled handled"), row("e", None, None, "handled", _at("2024-02-01")), row("f", None, None, None)], cols)
    q = spark.createDataFrame([("q", "r", "handle the errors", _at("2024-03-01")), ("none", "r", "...", _at("2024-03-01"))], "query_id string, repository_id string, query string, cutoff timestamp")
    got = [(r.chunk_id, r.score, r["rank"]) for r in search.lexical(q, c).orderBy("rank").collect()]
    # a: three stems in the content; b: the word itself in the symbol; e: the row indexed last; stop words of contents never count
    assert got == [("a", 1.2, 1), ("b", 1.0, 2), ("e", 0.4, 3)]
    assert search.lexical(q, c.limit(0)).count() == 0


def test_vectors_that_are_not_finite_answer_nothing(spark):
    at = _at("2024-01-01")
    c = spark.createDataFrame([(x, "r", None, None, None, None, "issue", "d", at, None, at) for x in "abcd"], "chunk_id string, repository_id string, path string, symbol_name string, parent_symbol string, symbol_kind string, source_type string, document_id string, available_at timestamp, superseded_at timestamp, indexed_at timestamp")
    e = spark.createDataFrame([("a", "r", [1.0, 0.0]), ("b", "r", [math.nan, 1.0]), ("c", "r", [0.0, 0.0]), ("d", "r", [math.inf, 1.0])], "chunk_id string, repository_id string, embedding array<float>")
    q = spark.createDataFrame([("q", "r", at, [1.0, 0.0]), ("n", "r", at, [math.nan, 0.0])], "query_id string, repository_id string, cutoff timestamp, vector array<float>")
    assert [(r.query_id, r.chunk_id) for r in search.dense(q, c, e).collect()] == [("q", "a")]


def _vectors(spark, chunks, vectors, queries):
    """Tables of the dense scan from (chunk, repository, available, superseded, indexed), (chunk, repository, vector), (query, repository, cutoff, vector)."""
    c = spark.createDataFrame([(i, r, None, None, None, None, "issue", "d", a, u, x) for i, r, a, u, x in chunks], "chunk_id string, repository_id string, path string, symbol_name string, parent_symbol string, symbol_kind string, source_type string, document_id string, available_at timestamp, superseded_at timestamp, indexed_at timestamp")
    return spark.createDataFrame(queries, "query_id string, repository_id string, cutoff timestamp, vector array<float>"), c, spark.createDataFrame(vectors, "chunk_id string, repository_id string, embedding array<float>")


def test_blocks_of_vectors_give_what_all_pairs_give(spark, monkeypatch):
    rng = random.Random(5)
    days = [_at(f"2024-01-{d:02}") for d in range(1, 29)]
    # few directions: many ties, repeated and scaled vectors; some vectors of another size; some not usable
    make = lambda: rng.choice([[float(rng.randint(-1, 2)) for _ in range(4)], [float(rng.randint(-2, 2)) / 3 for _ in range(4)], [1.0, 2.0], [math.nan, 1.0, 1.0, 1.0], [0.0] * 4, None])
    chunks = [(f"c{rng.randint(0, 150)}", rng.choice("rrrs"), rng.choice(days), rng.choice([None, *days]), rng.choice([None, *days[:3]])) for _ in range(400)]
    vectors = [(f"c{rng.randint(0, 150)}", rng.choice("rrs"), make()) for _ in range(400)]
    queries = [(f"q{rng.randint(0, 40)}", rng.choice("rrst"), rng.choice([None, *days]), make()) for _ in range(80)]
    best = {}
    last = {i: max((x for j, *_, x in chunks if j == i and x), default=None) for i, *_ in chunks}
    for q, qr, cut, y in queries:
        for i, r, a, u, x in chunks:
            if qr == r and x == last[i] and cut and a <= cut and (u is None or u > cut):
                for j, er, z in vectors:
                    if (j, er) == (i, r) and y and z and len(y) == len(z) and any(y) and any(z) and not any(map(math.isnan, y + z)):
                        y32, z32 = (numpy.float32(v).tolist() for v in (y, z))
                        score = sum(a * b for a, b in zip(y32, z32)) / (math.sqrt(sum(b * b for b in z32)) * math.sqrt(sum(a * a for a in y32)))
                        best[q, i] = max(best.get((q, i), -2), round(score, 9))
    for limit, block in ((3, search.BLOCK), (3, 64), (1000, 100)):
        monkeypatch.setattr(search, "BLOCK", block)
        want = {(q, i, n, s) for q in {q for q, _ in best} for n, (s, i) in enumerate(sorted((-s, i) for (p, i), s in best.items() if p == q)[:limit], 1)}
        got = search.dense(*_vectors(spark, chunks, vectors, queries), limit).collect()
        assert {(r.query_id, r.chunk_id, r["rank"], -r.score) for r in got} == want and len(got) == len(want) > 40


def test_vectors_are_not_sent_once_a_pair(spark):
    rng, at = random.Random(1), _at("2024-01-01")
    vector = lambda: [rng.gauss(0, 1) for _ in range(64)]
    tables = _vectors(spark, [(f"c{i}", "r", at, None, at) for i in range(400)], [(f"c{i}", "r", vector()) for i in range(400)], [(f"q{i}", "r", at, vector()) for i in range(100)])
    sc = spark.sparkContext._jsc.sc()

    def written() -> int:
        time.sleep(0.5)
        spark.range(1).collect()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert len(search.dense(*tables, 3).collect()) == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # 500 vectors of 256 bytes, in no more than ten exchanges; the 40,000 pairs would be 10 MB
    assert 0 < written() - before < 10 * 500 * 256


# ---- sinks, providers, experiments
def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([("q", 2, "c2", "TEST", "local", None, None, 1, 1, False, "b"), ("q", 1, "c1", "PRIMARY", "retrieved_primary", 3, 4, 1, 1, False, "a")], "query_id string, item int, chunk_id string, context_role string, reasons string, start_line int, end_line int, characters int, original_characters int, truncated boolean, content string")
    p = json.loads(sinks.pack_json(items).first().pack)
    assert p["schemaVersion"] == 1 and [e["chunk_id"] for e in p["evidence"]] == ["c1", "c2"] and "start_line" not in p["evidence"][1] and p["characters"] == 2
    assert sinks.pack_text(items).first().pack == "[1] PRIMARY c1:3-4\na\n\n[2] TEST c2\nb"
    assert sinks.stable_hash({"b": 1, "a": [2]}) == sinks.stable_hash({"a": [2], "b": 1})
    f = str(tmp_path / "x.json")
    sinks.write_once(f, {"a": 1})
    with pytest.raises(FileExistsError):
        sinks.write_once(f, {"a": 1})
    out = io.StringIO()
    sinks.Log(out, job="j").child(stage="s")("info", "done", n=1)
    assert json.loads(out.getvalue())["stage"] == "s" and json.loads(out.getvalue())["n"] == 1
    assert sinks.table_text([{"a": 1.5, "b": None}], ["a", "b"]) == "a       b\n1.5000"


def test_calls_are_repeated_as_asked():
    answers = iter([providers.Answer(500), providers.Answer(403, wait=5), providers.Answer(200, [{"n": 1}])])
    slept = []
    c = providers.Caller(lambda a: next(answers), slept.append)
    assert c.get("/x") == [{"n": 1}] and c.requests == 3 and slept == [1.0, 5]
    for status, wait, tries in ((404, None, 1), (403, 61, 1), (503, None, 4)):
        c = providers.Caller(lambda a, s=status, w=wait: providers.Answer(s, wait=w), slept.append)
        with pytest.raises(providers.ProviderError):
            c.get("/x")
        assert c.requests == tries
    pages = {1: [{"n": i} for i in range(100)], 2: [{"n": 100}]}
    c = providers.Caller(lambda a: providers.Answer(200, pages[int(a)]), slept.append)
    assert len(list(c.pages(str, 150))) == 101 and len(list(c.pages(str, 30))) == 30
    assert providers.commits(providers.Caller(lambda a: providers.Answer(409), slept.append), "o", "r", 5) == []


def test_settings_and_manifest(spark, tmp_path):
    e = providers.environment("# c\nexport A='x y'\nB=1 # note\nC=\"q\"\nbad", {"B": "2"})
    assert e == {"A": "x y", "B": "2", "C": "q"}
    assert providers.embedder({}).dimensions == 512 and providers.reranker({}) is None
    for bad in ({"EMBEDDING_PROVIDER": "hosted"}, {"EMBEDDING_PROVIDER": "z"}):
        with pytest.raises(ValueError):
            providers.embedder(bad)
    with pytest.raises(ValueError, match="this machine"):
        providers.reranker({"RERANKER_URL": "http://far.example:1/"})
    m = tmp_path / "m.json"
    tasks = [{"id": f"t{i}", "category": "c", "repository": "r", "split": "final" if i < 12 else "pilot"} for i in range(14)]
    m.write_text(json.dumps({"version": 1, "tasks": tasks}))
    assert providers.read_manifest(spark, str(m)).count() == 14
    m.write_text(json.dumps({"version": 1, "tasks": tasks[1:]}))
    with pytest.raises(ValueError, match="11 final"):
        providers.read_manifest(spark, str(m))
    assert providers.landed(spark, str(tmp_path / "none"), "a int").count() == 0
    providers.land([{"a": 1}], str(tmp_path / "rows.jsonl"))
    assert providers.landed(spark, str(tmp_path / "rows.jsonl"), "a int").first().a == 1
    one = spark.createDataFrame([("https://host.example/o/n",), ("https://host-example/o/n",)], "u string").select(landed.repository_address(F.col("u"), "host.example")).collect()
    assert [r[0] is not None for r in one] == [True, False]
    u = spark.createDataFrame([("https://host.example/o/n.git",), ("https://u@host.example/o/n",), ("http://host.example/o/n",)], "u string")
    assert [r[0] is not None for r in u.select(landed.repository_address(F.col("u"))).collect()] == [True, False, False]


def test_experiment_details(spark):
    d = spark.createDataFrame([(0, None, "", 1), (0, None, "", 0), (1, None, "Request timed out", 0), (1, None, "HTTP 429", 0), (1, "KILL", "", 0), (1, None, "", 0)], "code int, signal string, output string, turns int")
    assert [r[0] for r in d.select(experiment.completion(F.col("code"), F.col("signal"), F.col("output"), F.col("turns"))).collect()] == ["completed", "incomplete", "timed_out", "rate_limited", "killed", "failed"]
    p = spark.createDataFrame([(1, "a", 3, 1), (1, "b", None, None), (1, "a", 1, 0)], "run_id int, path string, insertions int, deletions int")
    assert _rows(experiment.patch_stats(p), "run_id", "insertions", "deletions", "files") == [(1, 4, 1, 2)]
    calls = spark.createDataFrame([(1, 1, 10, ["a", "b", "b"], ["a", "z"])], "run_id int, call_id int, elapsed_ms int, surfaced array<string>, relevant array<string>")
    later = spark.createDataFrame([(1, "a", 5, "read"), (1, "a", 20, "edit"), (1, "b", 30, "read")], "run_id int, path string, elapsed_ms int, action string")
    assert _rows(experiment.treatment_calls(calls, later), "surfaced", "relevant", "opened_later", "edited_later") == [(2, 1, 1, 1)]
    ids = lambda n: spark.createDataFrame([("r",)] * n, "repository_id string")
    frozen = spark.createDataFrame([("r", "s", 2, 1, 0)], "repository_id string, revision string, documents int, chunks int, embeddings int")
    files = spark.createDataFrame([("r", "s")], "repository_id string, last_known_commit_sha string")
    got = experiment.preflight(frozen, spark.createDataFrame([("r",)], "id string"), ids(2), ids(3), ids(0), files)
    assert _rows(got, "what", "expected", "actual") == [("chunks", "1", "3")]
