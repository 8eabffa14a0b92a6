"""Evaluation and experiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assess
from ..operators import evaluate as ev
from ..operators import experiment as ex
from ..operators import ranking, requests, search
from ..sources.tables import read
from . import retrieval as rt

CUTOFFS = [1, 3, 5, 10]


def _cases(spark, d):
    """Questions as cases: what structured search finds first, by reference, is what lexical search should find."""
    q, c = rt.questions(spark, d), rt.rows(spark, d)
    refs = c.select("chunk_id", "source_reference").distinct()
    t = search.structured(q, c, 20).join(refs, "chunk_id").groupBy("query_id", "source_reference").agg(F.min("rank").alias("r"))
    t = ranking.rank_by(t, ["query_id"], [F.col("r"), F.col("source_reference")], "target_id", 3)
    null = F.lit(None).cast("string")
    targets = t.select(F.col("query_id").alias("case_id"), "target_id", (F.lit(4) - F.col("target_id")).cast("int").alias("grade"), null.alias("t_path"), null.alias("t_source_type"), F.col("source_reference").alias("t_source_reference"), null.alias("t_symbol_name"))
    results = search.lexical(q, c, 50).join(refs, "chunk_id").select(F.col("query_id").alias("case_id"), "rank", "path", "source_type", "source_reference", "symbol_name")
    cases = q.select(F.col("query_id").alias("case_id"), F.substring_index("query_id", ":", -1).alias("category"))
    return cases, results, targets


def _per_case(spark, d):
    cases, results, targets = _cases(spark, d)
    m = ev.metrics(cases, ev.credit(results, targets), targets, CUTOFFS)
    return m.join(cases, "case_id")


def ref_m4_metrics(spark, d):
    m = _per_case(spark, d)
    return m.select("case_id", "k", "hit", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "mrr")])


def ref_a8_summary(spark, d):
    s = ev.summarise(_per_case(spark, d), ["k"], "category")
    return s.select("k", F.coalesce("category", F.lit("all")).alias("category"), "cases", *[F.round(c, 6).alias(c) for c in ("hit", "precision", "recall", "ndcg", "mrr")])


def _runs(spark, d):
    """The event log as runs: users are tasks, errors against clicks the conditions, the hour the retry."""
    e = read(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value").filter(F.col("event_type").isin("click", "error"))
    return e.select(F.col("user_id").alias("task_id"), F.col("event_type").alias("condition"), F.unix_micros(F.col("ts").cast("timestamp")).alias("retry"), F.col("event_id").alias("run_id"), "value", (F.col("value") > 10).alias("passed"))


def ref_a18_latest_attempts(spark, d):
    return ex.latest_attempt(_runs(spark, d)).select("task_id", "condition", "run_id")


def ref_q15_experiment(spark, d):
    """The paired comparison: the 2 by 2 table, its exact probability, and the median difference."""
    p = ex.paired(ex.latest_attempt(_runs(spark, d)), "click", "error", ["passed", "value"])
    return ex.outcomes(p, "passed", ex.median_difference("value").alias("median")).select(F.col("both").alias("both_passed"), "only_a", "only_b", "neither", F.round("p_value", 6).alias("p_value"), F.round("median", 6).alias("median_difference"))


def ref_w18_pair_order(spark, d):
    return ex.pair_order(read(spark, d, "nation", "n_nationkey").withColumnRenamed("n_nationkey", "task_id"), "seed-1")


def ref_a18_by_category(spark, d):
    """Pairs and passes by the decade of the task."""
    p = ex.paired(ex.latest_attempt(_runs(spark, d)), "click", "error", ["passed"]).withColumn("category", F.col("task_id") % 10)
    return ex.outcomes_by(p, "category")


BUDGET = 8_000


def _pack_cases(spark, d):
    """Lexical results as evidence for what structured search finds first: its best reference is required, the others support it."""
    cases, _, targets = _cases(spark, d)
    q, c = rt.questions(spark, d), rt.rows(spark, d)
    about = rt.chunks(spark, d).select("chunk_id", "source_reference", "content", "start_line", "end_line")
    none = F.lit(None).cast("array<struct<imported_name:string,target_symbol:string,resolution:string>>")
    evidence = search.lexical(q, c, 10).join(about, "chunk_id").select(F.col("query_id").alias("case_id"), F.col("rank").alias("item"), "path", "source_type", "source_reference", "symbol_name", "start_line", "end_line", "content", none.alias("relationships"))
    return cases, evidence, targets.withColumn("need", F.when(F.col("target_id") == 1, "required").otherwise("supporting"))


_SHOWN = ["required_recall", "supporting_recall", "precision", "noise", "budget_use"]


def ref_a23_case_metrics(spark, d):
    m = assess.case_metrics(*_pack_cases(spark, d), BUDGET)
    return m.select("case_id", *[F.round(c, 6).alias(c) for c in _SHOWN], "complete", "distinct_relevant_files", "items", "characters")


def ref_a10_context(spark, d):
    cases, evidence, targets = _pack_cases(spark, d)
    m = assess.case_metrics(cases, evidence, targets, BUDGET).join(cases, "case_id")
    return assess.summarise(m, "category").select(F.coalesce("category", F.lit("all")).alias("category"), "cases", *[F.round(c, 6).alias(c) for c in [*_SHOWN, "complete", "items"]])


def ref_a24_outcomes(spark, d):
    """What became of each target: five results against a pool of fifty."""
    _, pool, targets = _cases(spark, d)
    return assess.outcomes(targets, pool.filter("rank <= 5"), pool).select("case_id", "target_id", F.coalesce("final_rank", F.lit(-1)).alias("final_rank"), F.coalesce("candidate_rank", F.lit(-1)).alias("candidate_rank"), "outcome")


def _rerank_pool(spark, d):
    r = search.lexical(rt.questions(spark, d), rt.rows(spark, d), 20).select("query_id", "chunk_id", F.col("rank").alias("rrf_rank"))
    c = rt.chunks(spark, d)
    fields = ["path", "source_type", "start_line", "end_line", "language", "symbol_name", "parent_symbol", "source_reference", "content"]
    return r.join(c.select("chunk_id", requests.rerank_text(*[F.col(x) for x in fields]).alias("rerank_text")), "chunk_id")


def ref_q5_reranked(spark, d):
    """The ten best of twenty by the share of the question's words that their texts hold."""
    r = requests.reranked(_rerank_pool(spark, d), rt.questions(spark, d), requests.overlap_reranker, 10, 20)
    return r.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("score"), "final_rank")


def ref_s11_rerank_bytes(spark, d):
    return requests.diagnostics(_rerank_pool(spark, d))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("ref_")}

_METRICS = f"""{rt._BASE},
rf as (select distinct id as chunk_id, source_reference from document_chunks),
t0 as (select s.query_id, rf.source_reference, min(s.rank) as r from str s join rf using (chunk_id) where s.rank <= 20 group by 1, 2),
t1 as (select *, row_number() over (partition by query_id order by r, source_reference) as target_id from t0),
t as (select query_id as case_id, target_id, 4 - target_id as grade, source_reference from t1 where target_id <= 3),
res as (select l.query_id as case_id, l.rank, rf.source_reference from lex l join rf using (chunk_id) where l.rank <= 50),
cr as (select t.case_id, t.target_id, t.grade, min(res.rank) as rank from t join res on res.case_id = t.case_id and res.source_reference = t.source_reference group by 1, 2, 3),
ks as (select q.query_id as case_id, v.k, split_part(q.query_id, ':', 2) as category from q, (values (1), (3), (5), (10)) v(k)),
m as (select ks.case_id, ks.k, ks.category,
  (select count(*) from t where t.case_id = ks.case_id) as targets,
  (select coalesce(sum((2 ** grade - 1) / log2(target_id + 1)), 0) from t where t.case_id = ks.case_id and target_id <= ks.k) as ideal,
  (select count(*) from cr where cr.case_id = ks.case_id and rank <= ks.k) as found,
  (select coalesce(sum((2 ** grade - 1) / log2(rank + 1)), 0) from cr where cr.case_id = ks.case_id and rank <= ks.k) as dcg,
  (select min(rank) from cr where cr.case_id = ks.case_id and rank <= 10) as first from ks),
pc as (select case_id, k::int as k, category, case when found > 0 then 1.0 else 0.0 end::double as hit, (found::double / k) as precision, coalesce(found::double / nullif(targets, 0), 0) as recall, case when ideal > 0 then dcg / ideal else 0 end::double as ndcg, coalesce(1.0::double / first, 0) as mrr from m)"""
_RUNS = """r as (select user_id as task_id, event_type as condition, epoch_us(ts) as retry, event_id as run_id, value, value > 10 as passed from events where event_type in ('click', 'error')),
l as (select * from (select *, row_number() over (partition by task_id, condition order by retry desc, run_id desc) as rn from r) where rn = 1)"""
_PACKS = f"""{_METRICS},
ct as (select distinct on (id) id as chunk_id, path, source_type, language, symbol_name, parent_symbol, source_reference, start_line, end_line, content from document_chunks),
ev as (select l.query_id as case_id, l.rank as item, ct.path, ct.source_reference, length(ct.content) as n, exists (select 1 from t where t.case_id = l.query_id and t.source_reference = ct.source_reference) as rel from lex l join ct using (chunk_id) where l.rank <= 10),
g as (select q.query_id as case_id, split_part(q.query_id, ':', 2) as category,
  (select count(*) from t where t.case_id = q.query_id and target_id = 1) as req, (select count(*) from t where t.case_id = q.query_id and target_id = 1 and exists (select 1 from ev where ev.case_id = t.case_id and ev.source_reference = t.source_reference)) as reqm,
  (select count(*) from t where t.case_id = q.query_id and target_id > 1) as sup, (select count(*) from t where t.case_id = q.query_id and target_id > 1 and exists (select 1 from ev where ev.case_id = t.case_id and ev.source_reference = t.source_reference)) as supm,
  (select count(*) from ev where ev.case_id = q.query_id) as items, (select count(*) from ev where ev.case_id = q.query_id and rel) as relevant, (select coalesce(sum(n), 0) from ev where ev.case_id = q.query_id) as characters,
  (select count(distinct path) from ev where ev.case_id = q.query_id and rel) as files from q),
cm as (select case_id, category, coalesce(reqm::double / nullif(req, 0), 0) as required_recall, coalesce(supm::double / nullif(sup, 0), 1) as supporting_recall, (req = reqm)::int as complete, coalesce(relevant::double / nullif(items, 0), 0) as precision, 1 - coalesce(relevant::double / nullif(items, 0), 0) as noise,
  characters::double / {BUDGET} as budget_use, files as distinct_relevant_files, items, characters::bigint as characters from g)"""
_TEXT = """concat_ws(chr(10), 'Path: ' || nullif(path, ''), 'Type: ' || nullif(source_type, ''), case when start_line is not null and end_line is not null then 'Lines: ' || start_line || '-' || end_line end, 'Language: ' || nullif(language, ''), 'Symbol: ' || nullif(symbol_name, ''), 'Parent: ' || nullif(parent_symbol, ''), 'Reference: ' || nullif(source_reference, ''), 'Content:' || chr(10) || coalesce(content, ''))"""
_POOL = f"{_PACKS}, po as (select l.query_id, l.chunk_id, l.rank as rrf_rank, txt from (select query_id, chunk_id, rank from lex) l join (select chunk_id, {_TEXT} as txt from ct) using (chunk_id) where l.rank <= 20)"
_WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
SQL = {
    "ref_a18_by_category": f"with {_RUNS} select a.task_id % 10 as category, count(*) as pairs, count(*) filter (where a.passed) as passed_a, count(*) filter (where b.passed) as passed_b from l a join l b using (task_id) where a.condition = 'click' and b.condition = 'error' group by 1",
    "ref_a23_case_metrics": f"with {_PACKS} select case_id, {', '.join(f'round({c}, 6) as {c}' for c in _SHOWN)}, complete, distinct_relevant_files, items, characters from cm",
    "ref_a10_context": f"with {_PACKS} select coalesce(category, 'all') as category, count(*) as cases, {', '.join(f'round(avg({c}), 6) as {c}' for c in [*_SHOWN, 'complete', 'items'])} from cm group by grouping sets ((category), ())",
    "ref_a24_outcomes": f"""with {_METRICS}, o as (select t.case_id, t.target_id, min(res.rank) filter (where res.rank <= 5) as f, min(res.rank) as c from t left join res on res.case_id = t.case_id and res.source_reference = t.source_reference group by 1, 2)
      select case_id, target_id, coalesce(f, -1) as final_rank, coalesce(c, -1) as candidate_rank, case when f is not null then 'successfully_returned' when c is not null then 'reranked_below_cutoff' else 'absent_from_candidate_pool' end as outcome from o""",
    "ref_q5_reranked": f"""with {_POOL}, sc as (select po.query_id, po.chunk_id, rrf_rank, len(list_intersect({_WORDS.format('q.query')}, {_WORDS.format('txt')}))::double / greatest(1, len({_WORDS.format('q.query')})) as score from po join q using (query_id)),
      rk as (select *, row_number() over (partition by query_id order by score desc, rrf_rank, chunk_id)::int as final_rank from sc) select query_id, chunk_id, round(score, 6) as score, final_rank from rk where final_rank <= 10""",
    "ref_s11_rerank_bytes": f"with {_POOL} select query_id, count(*) as candidates, sum(octet_length(encode(txt)))::bigint as bytes from po group by 1",
    "ref_m4_metrics": f"with {_METRICS} select case_id, k, hit, round(precision, 6) as precision, round(recall, 6) as recall, round(ndcg, 6) as ndcg, round(mrr, 6) as mrr from pc",
    "ref_a8_summary": f"with {_METRICS} select k, coalesce(category, 'all') as category, count(*) as cases, round(avg(hit), 6) as hit, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(ndcg), 6) as ndcg, round(avg(mrr), 6) as mrr from pc group by grouping sets ((k, category), (k))",
    "ref_a18_latest_attempts": f"with {_RUNS} select task_id, condition, run_id from l",
    "ref_q15_experiment": f"""with {_RUNS}, p as (select a.passed as pa, b.passed as pb, b.value - a.value as d from l a join l b using (task_id) where a.condition = 'click' and b.condition = 'error'),
      c as (select count(*) filter (where pa and pb) as both_passed, count(*) filter (where pa and not pb) as only_a, count(*) filter (where not pa and pb) as only_b, count(*) filter (where not pa and not pb) as neither, median(d) as md from p),
      t as (select c.*, (select sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) from range(0, least(only_a, only_b) + 1) x(i)) as tail from c)
      select both_passed, only_a, only_b, neither, round(case when only_a + only_b = 0 then 1.0 else least(1.0, 2 * tail) end, 6) as p_value, round(md, 6) as median_difference from t""",
    "ref_w18_pair_order": """select n_nationkey as task_id, case when ('0x' || left(sha256('seed-1:' || n_nationkey::varchar), 2))::int % 2 = 0 then 'baseline' else 'treatment' end as first,
      row_number() over (order by sha256('seed-1:' || n_nationkey::varchar), n_nationkey)::int as place from nation""",
}
