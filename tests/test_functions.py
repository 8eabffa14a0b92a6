"""Scalar functions, generators, readers and snapshots on hand-made cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import files as fl
from palimpsest.functions import intents as it
from palimpsest.functions import roles as ro
from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vx
from palimpsest.operators import chunking, upsert
from palimpsest.sources import landed
from palimpsest.streaming import ingest


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("query, terms", [("getProxySession works", ["proxy", "session"]), ("where are HTTPServers handled", ["http", "servers", "handled", "server", "handl"]), ("is the", []), ("resized running", ["resized", "running", "runn"])])
def test_structural_terms(spark, query, terms):
    assert _one(spark, query, tx.structural_terms) == terms


@pytest.mark.parametrize(
    "query, intents",
    [("write tests for the parser", ["tests"]), ("src/auth/session.ts", ["exact_symbol", "authentication"]), ("parseConfig", ["exact_symbol"]), ("API", ["exact_symbol"]), ("étest", ["tests"]), ("hello", ["general"]), ("how does the error handler work", ["implementation", "error_handling"]), (None, ["general"]), ("", ["general"])],
)
def test_intents(spark, query, intents):
    assert [s.intent for s in _one(spark, query, it.signals)] == intents


@pytest.mark.parametrize(
    "path, role",
    [("src/a.test.ts", "unit_test"), ("e2e/a.ts", "e2e_test"), ("a/__fixtures__/b.json", "fixture"), ("db/migrations/1.sql", "migration"), ("db/schema.ts", "database_schema"), ("docs/api-reference/x.md", "generated_reference_documentation"), ("openapi.yaml", "api_definition"), ("gen/x.ts", "generated"), ("README", "documentation"), ("package.json", "configuration"), (".github/workflows/a.yml", "configuration"), ("scripts/x.ts", "script"), ("a/x.d.ts", "type_definition"), ("src\\a.ts", "production_implementation"), ("logo.png", "unknown"), (None, "unknown")],
)
def test_roles(spark, path, role):
    assert _one(spark, path, lambda c: ro.classify(F.lit("source_code"), c, F.lit(None).cast("string")))["role"] == role


def test_roles_by_type_and_kind(spark):
    assert _one(spark, "a.ts", lambda c: ro.classify(F.lit("issue"), c, F.lit(None).cast("string")))["role"] == "development_history"
    assert _one(spark, "a.ts", lambda c: ro.classify(F.lit("source_code"), c, F.lit("enum")))["role"] == "type_definition"
    c = spark.range(1).select(ro.compatibility(it.signals(F.lit("how does x work")), F.lit("production_implementation"), F.lit(False), F.lit(None).cast("string")).alias("a"), ro.compatibility(it.signals(F.lit("fooBar")), F.lit("unknown"), F.lit(True), F.lit("fooBar")).alias("b")).first()
    assert c.a == pytest.approx(0.65) and c.b == 1.0


def test_languages_and_exclusions(spark):
    assert [_one(spark, p, fl.language) for p in ("a/Dockerfile", "x.TSX", ".env", "b")] == ["Dockerfile", "TypeScript", None, None]
    paths = ["yarn.lock", "node_modules/a.js", "dist/a.js", "a.snap", "a.min.js", "x.svg", "locales/en-US.json", "locales/de-DE.json", "i/locales/fr-FR/a.json", "api/openapi.json", "api/src/openapi.json", "api/src/paths/a.json", "src/a.ts"]
    got = {r.path: r.excluded for r in fl.exclusion_by_path(spark.createDataFrame([("r", p) for p in paths], "repository_id string, path string")).collect()}
    assert [got[p] for p in paths] == ["lock_file", "vendored_dependency", "generated_output", "snapshot", "minified", "static_asset", None, "translated_locale", None, "generated_bundle", None, None, None]
    f = spark.createDataFrame([("r", "a.ts", bytearray(b"// @generated\nx")), ("r", "b.ts", bytearray(b"")), ("r", "c.ts", bytearray(b"\x00\x01")), ("r", "d.ts", bytearray(b"ok"))], "repository_id string, path string, content binary")
    assert {r.path: r.excluded for r in fl.admission(f).collect()} == {"a.ts": "generated_file", "b.ts": "empty", "c.ts": "binary", "d.ts": None}


def test_lengths_and_identity(spark):
    assert _one(spark, "\U0001f600a", tx.utf16_length) == 3
    want = hashlib.sha256("1:a3:\U0001f600b".encode()).hexdigest()
    assert _one(spark, "\U0001f600b", lambda c: tx.identity(F.lit("a"), c)) == want
    assert _one(spark, "ab\ncd" * 20, lambda c: F.length(tx.truncate_lines(c, F.lit(60)))) <= 60


def test_rounding_as_in_sql(spark):
    # 0.2604275 times a million is 260427.49999999997 in double precision
    for x, y in ((0.2604275, 0.260427), (-0.2604275, -0.260427), (0.2604285, 0.260429), (1.0, 1.0), (0.0, 0.0)):
        assert _one(spark, x, lambda c: vx.rounded(c, 6), "double") == y


def test_vectors(spark):
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = v.select(vx.cosine(F.col("a"), F.col("b")).alias("c"), vx.cosine(F.col("a"), F.col("z")).alias("n"), vx.is_usable(F.col("z"), 2).alias("u")).first()
    assert r.c == pytest.approx(2**-0.5) and r.n is None and r.u is False
    e = vx.hash_embedding("Hello hello world", 16)
    assert sum(x * x for x in e) == pytest.approx(1) and vx.hash_embedding("", 4) == [0.0] * 4 and e == vx.hash_embedding("hello HELLO world", 16)


def test_prose_and_windows():
    assert chunking.prose_chunks("a\n\nb") == ["a\n\nb"]
    parts = chunking.prose_chunks("w " * 2000)
    assert all(len(p) <= 1800 for p in parts) and " ".join(parts).split() == ["w"] * 2000
    w = chunking.code_windows("\n".join(f"l{i}" for i in range(300)))
    assert [(a, b) for _, a, b in w] == [(1, 120), (101, 220), (201, 300)]
    assert [len(c) for c, _, _ in chunking.code_windows("x" * 25_000)] == [12_000, 12_000, 1_000]


def test_structural_chunks_and_fallback():
    src = "import a from 'a';\n\nexport function f() {\n  return 1;\n}\n\nexport class C {\n  m() {}\n}\n"
    kind, parts = chunking.structural_chunks(src, "TypeScript", "x.ts")
    assert kind == "structural" and [(p["symbol_name"], p["start_line"], p["end_line"]) for p in parts] == [(None, 1, 1), ("f", 3, 5), ("C", 7, 9)]
    assert chunking.structural_chunks("function f( {", "TypeScript", "x.ts")[0] == "line_windows"
    assert chunking.top_symbols("x", "COBOL")[0] == "unsupported"


def test_chunk_documents_edge_cases(spark):
    d = spark.createDataFrame([("a", "issue", "hello", None, None), ("b", "issue", None, None, None), ("c", "issue", "  ", None, None), ("d", "source_code", "def f():\n    pass\n", "x.py", "Python")], "id string, source_type string, text string, path string, language string")
    got = chunking.with_identity(chunking.chunk_documents(d)).collect()
    assert {(r.document_id, r.chunk_index) for r in got} == {("a", 0), ("d", 0)} and all(len(r.chunk_id) == 64 for r in got)


def test_imports():
    got = chunking.imports_of('import a, { b as c, type D } from "./x";\nimport * as n from "y";\nimport "z";\nexport { q } from "./w";\nexport * from "v";\nimport type { T } from "t";')
    assert [(k, b, i, l, t, s) for k, b, i, l, t, s, _ in got] == [("imports", "default", "default", "a", False, "./x"), ("imports", "named", "b", "c", False, "./x"), ("imports", "named", "D", "D", True, "./x"), ("imports", "namespace", "*", "n", False, "y"), ("imports", "side_effect", None, None, False, "z"), ("reexports", "named", "q", "q", False, "./w"), ("reexports", "namespace", "*", None, False, "v"), ("imports", "named", "T", "T", True, "t")]


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 2)], "k int, v string, t int")
    got = sorted(tuple(r) for r in upsert.upsert(old, new, ["k"], [F.col("t").desc()]).collect())
    assert got == [(1, "a", 1), (2, "d", 3), (3, "e", 2)]
    repos = spark.createDataFrame([("i1", "p", "7", "o", "n"), ("i2", "p", None, "o", "m")], "id string, provider string, provider_id string, owner string, name string")
    fresh = spark.createDataFrame([("x", "p", "7", "o2", "n2"), ("y", "p", "8", "o", "m"), ("z", "p", "9", "q", "q")], repos.schema)
    assert sorted((r.id, r.name) for r in upsert.upsert_repository(repos, fresh).collect()) == [("i1", "n2"), ("i2", "m"), ("z", "q")]
    kids, orphans = upsert.attach_parent(spark.createDataFrame([(1, "x"), (9, "y")], "number int, body string"), spark.createDataFrame([("p", 1)], "id string, number int"), ["number"], "issue_id")
    assert kids.count() == 1 and orphans.count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "tree/a").mkdir(parents=True)
    (tmp_path / "tree/a/x.py").write_text("x")
    assert [(r.path, r.language, r.size) for r in landed.read_tree(spark, str(tmp_path / "tree"), "rev").collect()] == [("a/x.py", "Python", 1)]
    (tmp_path / "log").write_text("\x1e".join("\x00".join(["s", "A", "", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", "subject", b]) for b in ("", "body\n")))
    assert sorted(r.message for r in landed.read_history(spark, str(tmp_path / "log")).collect()) == ["subject", "subject\n\nbody"]
    b = {"version": 1, "name": "n", "cases": [{"id": "c", "query": "q", "repositoryId": "r", "relevant": [{"path": "p", "grade": 2}, {"symbolName": "s"}]}, {"id": "c", "query": " ", "repositoryId": "r", "relevant": [{}]}]}
    (tmp_path / "b.json").write_text(json.dumps(b))
    cases, targets = landed.read_benchmark(spark, "b.json", ["/none", str(tmp_path)])
    assert cases.count() == 2 and {r.fault for r in landed.corpus_faults(cases, targets).collect()} == {"repeated case id", "empty query", "selector without fields"}
    with pytest.raises(FileNotFoundError, match="/none/zz.json"):
        landed.read_benchmark(spark, "zz.json", ["/none"])
    u = spark.createDataFrame([("https://h.example/o/n.git",), ("https://u:p@h.example/o/n",), ("http://h.example/o/n",), ("https://h.example/o",), ("https://h.example/o/n?x=1",)], "u string").select(landed.repository_address(F.col("u")).alias("a")).collect()
    assert [(r.a.owner, r.a.name) if r.a else None for r in u] == [("o", "n"), None, None, None, None]
    assert [r.ok for r in landed.health(spark, bad=lambda: 1 / 0).collect()] == [True, False]


def test_event_stream_and_upsert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"receivedAt": "2024-01-01T00:00:00Z", "elapsedMs": 5, "event": json.dumps({"type": "x", "item": {"command": "ls"}})}), "{broken", json.dumps({"receivedAt": "2024-01-01T00:01:00Z", "elapsedMs": 9, "event": json.dumps({"type": "x"})})]
    (tmp_path / "in/a.jsonl").write_text("\n".join(lines))
    assert landed.read_events(spark.read.text(str(tmp_path / "in"))).count() == 2
    state = {0: spark.createDataFrame([("x", 1)], "type string, n bigint")}

    def write(df, epoch):
        state[epoch + 1] = spark.createDataFrame(df.collect(), "type string, n bigint")

    events = ingest.event_lines(spark, str(tmp_path / "in")).select("type", F.col("elapsedMs").alias("n"))
    q = ingest.upsert_stream(events, lambda: state[max(state)], write, ["type"], [F.col("n").desc()], str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [tuple(r) for r in state[max(state)].collect()] == [("x", 9)]
