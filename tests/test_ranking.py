"""Ranked lists against hand-computed values and a greedy re-statement."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import evaluate, experiment, graph, pack, ranking


def _fused(spark, rows):
    return [(r.chunk_id, r.rrf_score) for r in ranking.fuse(spark.createDataFrame(rows, "query_id int, branch string, chunk_id string, rank int"), ["dense", "lexical", "structured"]).orderBy("rrf_rank").collect()]


def test_fusion_adds_reciprocal_ranks(spark):
    got = _fused(spark, [(1, "dense", "d", 1), (1, "dense", "s", 2), (1, "lexical", "s", 1), (1, "lexical", "l", 2)])
    assert [c for c, _ in got] == ["s", "d", "l"]
    assert [s for _, s in got] == pytest.approx([1 / 62 + 1 / 61, 1 / 61, 1 / 62])
    got = _fused(spark, [(1, "dense", "b", 1), (1, "dense", "b", 2), (1, "lexical", "a", 1)])
    assert [c for c, _ in got] == ["a", "b"] and got[1][1] == pytest.approx(1 / 61)
    assert _fused(spark, []) == []


def _greedy(rows, limit, cap):
    first = {}
    for i, p, ex in rows:
        if p is not None and ex and p not in first:
            first[p] = i
    protected = set(list(first.values())[:limit])
    left, taken, count, out = len(protected), set(), {}, []
    for i, p, _ in rows:
        own = i in protected
        if own:
            left -= 1
        elif len(out) >= limit - left:
            continue
        if p is not None:
            room = cap - (1 if first.get(p) in protected and first[p] not in taken and not own else 0)
            if count.get(p, 0) >= (cap if own else room):
                continue
            count[p] = count.get(p, 0) + 1
        out.append(i)
        if own:
            taken.add(i)
    return out


def test_diversification_equals_the_greedy_rule(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for q in range(120):
        lst = [(i, rng.choice([None, "a", "b", "c", "d"]), rng.random() < 0.25) for i in range(1, rng.randint(1, 14))]
        rows += [(q, i, p, e) for i, p, e in lst]
        want |= {(q, i) for i in _greedy(lst, 5, 2)}
    got = ranking.diversify(spark.createDataFrame(rows, "query_id int, rank int, path string, exact boolean"), 5, 2, ["query_id"])
    assert {(r.query_id, r.rank) for r in got.collect()} == want


def test_prior_moves_fitting_roles_up(spark):
    f = spark.createDataFrame([(1, "a", 0.0164, 1, 0.5), (1, "b", 0.0161, 2, 0.9), (1, "c", 0.0159, 3, None)], "query_id int, chunk_id string, rrf_score double, rrf_rank int, compatibility double")
    assert [r.chunk_id for r in ranking.role_prior(f, "weak").orderBy("final_rank").collect()] == ["b", "a", "c"]
    assert [(r.chunk_id, r.role_rank) for r in ranking.role_prior(f, "none").orderBy("final_rank").collect()] == [("a", None), ("b", 1), ("c", None)]


def test_rerank_needs_a_score_each(spark):
    p = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rrf_rank int")
    s = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.9)], "query_id int, chunk_id string, score double")
    assert [r.chunk_id for r in ranking.rerank(p, s, 2).orderBy("final_rank").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="one finite score"):
        ranking.rerank(p, s.limit(1), 2).collect()


def test_reserve_swaps_from_the_tail(spark):
    schema = "query_id int, chunk_id string, path string, exact boolean, rrf_rank int, relationship_rank int"
    pool = spark.createDataFrame([(1, "a", "p", False, 1, None), (1, "b", "q", False, 2, None), (1, "c", "r", True, 3, None)], schema)
    rel = spark.createDataFrame([(1, "n", "s", False, None, 1), (1, "a", "p", False, None, 2)], schema)
    got = [r.chunk_id for r in graph.reserve(pool, rel).orderBy("pool_rank").collect()]
    assert got == ["a", "c", "n"]


def test_specifiers_configs_and_aliases(spark):
    files = spark.createDataFrame([("r", "a/b.ts"), ("r", "a/c/index.ts"), ("r", "x.js")], "repository_id string, path string")
    imp = spark.createDataFrame([(1, "r", "a/", "./b"), (2, "r", "a/", "./c"), (3, "r", "a/", "../x"), (4, "r", "a/", "../../x"), (5, "r", "a/", "lib"), (6, "r", "a/", "./none")], "import_id int, repository_id string, directory string, specifier string")
    assert {r.import_id: r.path for r in graph.resolve_specifiers(imp, files).collect()} == {1: "a/b.ts", 2: "a/c/index.ts", 3: "x.js"}
    conf = spark.createDataFrame([("r", "tsconfig.json"), ("r", "a/jsconfig.json"), ("r", "a/tsconfig.json")], "repository_id string, path string")
    assert {r.path: r.config for r in graph.closest_config(files, conf).collect()} == {"a/b.ts": "a/tsconfig.json", "a/c/index.ts": "a/tsconfig.json", "x.js": "tsconfig.json"}
    maps = spark.createDataFrame([("r", "t", "@/*"), ("r", "t", "@/lib/*"), ("r", "t", "@/lib/x")], "repository_id string, config string, pattern string")
    al = spark.createDataFrame([(1, "r", "t", "@/lib/y"), (2, "r", "t", "@/z"), (3, "r", "t", "@/lib/x"), (4, "r", "t", "q")], "import_id int, repository_id string, config string, specifier string")
    assert {r.import_id: (r.pattern, r.rest) for r in graph.resolve_aliases(al, maps).collect()} == {1: ("@/lib/*", "y"), 2: ("@/*", "z"), 3: ("@/lib/x", "")}


def _row(**k):
    base = dict(query_id=1, chunk_id="c", origin="primary", rank=1, exact=False, role="production_implementation", path=None, source_reference="s", symbol_id=None, symbol_name=None, symbol_kind=None, symbol_part=None, start_line=None, end_line=None, content="", relation=None, reason=None, priority=None)
    return base | k


def test_packs_choose_merge_and_cut(spark):
    schema = "query_id int, chunk_id string, origin string, rank int, exact boolean, role string, path string, source_reference string, symbol_id string, symbol_name string, symbol_kind string, symbol_part int, start_line int, end_line int, content string, relation string, reason string, priority int"
    rows = [
        _row(chunk_id="a", rank=1, path="p", symbol_name="f", symbol_kind="function", start_line=1, end_line=2, content="l1\nl2"),
        _row(chunk_id="b", rank=2, path="p", content="same path"),
        _row(chunk_id="x", rank=3, path="q", exact=True, content="e" * 600),
        _row(chunk_id="m", origin="local", rank=1, path="p", symbol_name="f", symbol_kind="function", start_line=2, end_line=3, content="l2\nl3", reason="same_symbol_context", priority=10),
        _row(chunk_id="big", origin="relation", rank=1, path="t", content="z" * 900, relation="imports"),
        _row(chunk_id="n", origin="relation", rank=2, path="t", content="small", relation="imported_by"),
    ]
    c = spark.createDataFrame([tuple(r[k.split()[0]] for k in schema.split(", ")) for r in rows], schema)
    intents = spark.createDataFrame([(1, ["implementation"])], "query_id int, intents array<string>")
    got = pack.build(c, intents, budget=400).orderBy("item").collect()
    assert [r.chunk_id for r in got] == ["x", "a", "n"]
    assert got[0].truncated and got[0].characters <= 200 and got[0].content.endswith(pack.MARKER)
    assert got[1].content == "l1\nl2\nl3" and (got[1].start_line, got[1].end_line) == (1, 3) and got[2].context_role == "CALLER"


def test_raw_top_stops_at_the_first_overflow(spark):
    r = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "c"), (2, 1, "x" * 50)], "query_id int, rank int, content string")
    assert [(x.query_id, x["rank"], x.kept) for x in pack.raw_top(r, 6).orderBy("query_id", "rank").collect()] == [(1, 1, 4), (1, 2, 2), (2, 1, 6)]


def test_graded_metrics(spark):
    n = None
    res = spark.createDataFrame([("c", 1, "p"), ("c", 2, "p"), ("c", 3, "q"), ("c", 4, "z")], "case_id string, rank int, path string").selectExpr("*", "string(null) source_type", "string(null) source_reference", "string(null) symbol_name")
    tg = spark.createDataFrame([("c", 1, 3, "p", n, n, n), ("c", 2, 1, "q", n, n, n)], "case_id string, target_id int, grade int, t_path string, t_source_type string, t_source_reference string, t_symbol_name string")
    cr = evaluate.credit(res, tg)
    assert sorted((r["rank"], r.target_id) for r in cr.collect()) == [(1, 1), (3, 2)]
    m = {r.k: r for r in evaluate.metrics(res.select("case_id"), cr, tg, [1, 3]).collect()}
    import math

    assert m[3].ndcg == pytest.approx((7 + 0.5) / (7 + 1 / math.log2(3))) and m[3].precision == pytest.approx(2 / 3) and m[1].recall == 0.5 and m[3].mrr == 1.0


def test_experiment_statistics(spark):
    rows = [(t, c, retry, f"{t}{c}{retry}", ok, v) for t, c, retry, ok, v in [(1, "a", 0, False, 1.0), (1, "a", 1, True, 2.0), (1, "b", 0, True, 5.0), (2, "a", 0, False, 1.0), (2, "b", 0, True, 2.0), (3, "a", 0, False, 4.0), (3, "b", 0, True, 4.0), (4, "a", 0, True, 0.0)]]
    runs = experiment.latest_attempt(spark.createDataFrame(rows, "task_id int, condition string, retry int, run_id string, passed boolean, v double"))
    p = experiment.paired(runs, "a", "b", ["passed", "v"])
    o = experiment.outcomes(p).first()
    assert (o.both, o.only_a, o.only_b, o.neither) == (1, 0, 2, 0) and o.p_value == pytest.approx(0.5)
    assert p.agg(experiment.median_difference("v").alias("m")).first().m == 1.0
    assert spark.range(1).select(experiment.mcnemar(F.lit(2), F.lit(8)).alias("p")).first().p == pytest.approx(0.109375)


def test_event_log_metrics(spark):
    e = spark.createDataFrame([("r", 1, 10, "item", "cat src/a.ts", None), ("r", 2, 20, "item", "rg foo", None), ("r", 3, 30, "turn.completed", None, "u1"), ("r", 4, 40, "turn.completed", None, "u2"), ("s", 1, 5, "x", None, None)], "run_id string, seq int, elapsed_ms int, type string, command string, usage string")
    m = {r.run_id: r for r in experiment.tool_metrics(e).collect()}
    assert (m["r"].calls, m["r"].read_calls, m["r"].search_calls, m["r"].files, m["r"].first_read_ms, m["r"].usage) == (2, 1, 1, 1, 10, "u2") and m["s"].calls == 0
