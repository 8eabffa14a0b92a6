"""Queries of the classifiers: intents, roles, languages, exclusions, terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files as fl
from ..functions import intents as it
from ..functions import roles as ro
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import chunking
from ..operators.evaluate import histogram
from ..sources.tables import read


def _titles(spark, d):
    """Titles and first lines of documents, as the queries that people might ask."""
    t = read(spark, d, "documents", "title", "text")
    first = F.substring_index("text", "\n", 1)
    return t.select(F.explode(F.array("title", first)).alias("query")).filter("query is not null").distinct()


def ref_c1_intents(spark, d):
    s = _titles(spark, d).withColumn("s", it.signals(F.col("query")))
    return s.select("query", F.array_join(F.transform("s", lambda x: F.concat(x["intent"], F.lit(":"), F.format_number(x["confidence"], 2))), ",").alias("intents"))


def ref_a7_roles(spark, d):
    """How many paths of each repository have each role, all roles listed."""
    f = read(spark, d, "repository_files", "repository_id", "path").distinct()
    f = f.withColumn("role", ro.classify(F.lit("source_code"), F.col("path"), F.lit(None).cast("string"))["role"])
    return histogram(f, ["repository_id"], "role", ro.ROLES)


def ref_n6_languages(spark, d):
    f = read(spark, d, "repository_files", "path").distinct()
    return f.select("path", fl.language(F.col("path")).alias("language"), F.nullif(F.substring(tx.extension(F.col("path")), 2, 99), F.lit("")).alias("extension"))


def ref_a12_exclusions(spark, d):
    """Why files stay out of the memory, by repository."""
    f = read(spark, d, "repository_files", "repository_id", "path").distinct()
    return fl.exclusion_by_path(f).groupBy("repository_id", F.coalesce("excluded", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("files"))


def ref_c6_generated_headers(spark, d):
    t = read(spark, d, "documents", "doc_id", "source_type", "text").filter("source_type = 'source_code'")
    return t.filter(fl.has_generated_header(F.col("text"))).select("doc_id")


def ref_s2_structural_terms(spark, d):
    return _titles(spark, d).select("query", F.array_join(tx.structural_terms(F.col("query")), " ").alias("terms"))


def ref_s8_symbol_terms(spark, d):
    s = read(spark, d, "document_chunks", "symbol_name").filter("symbol_name is not null").distinct()
    return s.select("symbol_name", F.array_join(tx.symbol_terms(F.col("symbol_name")), " ").alias("terms"))


def ref_m7_hash_embeddings(spark, d):
    """The deterministic embedding of every distinct title: the size and sum of its values."""
    t = read(spark, d, "documents", "title").filter("title is not null").distinct()
    e = t.withColumn("e", vx.hash_embedder(64)(F.col("title")))
    return e.select("title", F.size("e").alias("dimensions"), F.round(vx.norm(F.col("e")), 6).alias("length"))


def ref_g3_chunks(spark, d):
    """The memory's own chunks of every document version."""
    t = read(spark, d, "documents", "id", "source_type", "text", "path").distinct().withColumn("language", fl.language(F.col("path")))
    return chunking.with_identity(chunking.chunk_documents(t)).select("document_id", "chunk_index", "strategy", "start_line", "end_line", "symbol_name", "symbol_kind", "symbol_part", "content_hash", "chunk_id")


def ref_g7_imports(spark, d):
    return chunking.extract_imports(read(spark, d, "documents", "id", "text", "path").distinct())


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("ref_")}

_Q = "(select distinct query from (select title as query from documents union all select split_part(text, chr(10), 1) from documents) where query is not null)"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _intent_sql() -> str:
    trimmed = r"regexp_replace(regexp_replace(query, '^\s+', ''), '\s+$', '')"
    parts = []
    for k, intent in enumerate(it.INTENTS[:-1]):
        if intent == "exact_symbol":
            test = f"case when regexp_matches(q, {_quoted(it.FILE_SHAPE)}) or regexp_matches(q, {_quoted(it.PATH_SHAPE)}) or (regexp_matches(q, {_quoted(it.IDENTIFIER_SHAPE)}) and regexp_matches(q, {_quoted(it.IDENTIFIER_MARK)})) then 1.0 else 0.0 end"
        else:
            tests = []
            for i, c, _, case, words in it.RULES:
                if i == intent:
                    pattern = ("" if case else "(?i)") + rf"\b(?:{words})\b"
                    tests.append(f"case when regexp_matches(q, {_quoted(pattern)}) then {c} else 0.0 end")
            test = f"greatest({', '.join(tests)}, 0.0)"
        parts.append(f"select query, '{intent}' as intent, {k} as k, {test} as c from t")
    return f"""with t as (select query, {trimmed} as q from {_Q}), s as ({' union all '.join(parts)})
      select query, coalesce(string_agg(intent || ':' || printf('%.2f', c::double), ',' order by c desc, k) filter (where c > 0), 'general:0.25') as intents from s group by query"""


def _path() -> str:
    return r"lower(regexp_replace(replace(path, '\', '/'), '^\./', ''))"


def _role_sql() -> str:
    def test(p) -> str:
        if isinstance(p, list):
            return "(" + " and ".join(test(x) for x in p) + ")"
        return f"regexp_matches(p, {_quoted(p)})"

    whens = " ".join(f"when {' or '.join(test(x) for x in patterns)} then '{role}'" for role, _, patterns in ro.RULES)
    ending = ro._ending(ro.PRODUCTION)
    roles = ", ".join(f"('{r}')" for r in ro.ROLES)
    return f"""with f as (select distinct repository_id, path, {_path()} as p from repository_files),
      g as (select repository_id, case when path is null or path = '' then 'unknown' {whens} when p like '%.d.ts' then 'type_definition' when regexp_matches(p, {_quoted(ending)}) then 'production_implementation' else 'unknown' end as role from f),
      r as (select distinct repository_id, role from (select distinct repository_id from f), (values {roles}) v(role))
      select r.repository_id, r.role, count(g.role) as n from r left join g on g.repository_id = r.repository_id and g.role = r.role group by 1, 2"""


def _language_sql() -> str:
    names = " ".join(f"when '{k}' then '{v}'" for k, v in fl.LANGUAGE_BY_NAME.items())
    ends = " ".join(f"when '{k}' then '{v}'" for k, v in fl.LANGUAGE_BY_ENDING.items())
    return f"""with f as (select distinct path, lower(regexp_extract(path, '[^/]*$')) as b from repository_files), g as (select *, regexp_extract(b, '^.+?\\.([^.]*)$', 1) as e0 from f),
      h as (select path, b, lower(case when strpos(substr(b, 2), '.') > 0 then regexp_extract(b, '\\.([^.]*)$', 1) else '' end) as e from g)
      select path, coalesce(case b {names} end, case e {ends} end) as language, nullif(e, '') as extension from h"""


def _exclusion_sql() -> str:
    locks = ", ".join(f"'{x}'" for x in [*fl.LOCK_NAMES, ".eslintcache", ".stylelintcache"])

    def inside(names) -> str:
        return "regexp_matches(p, '(^|/)(" + "|".join(n.replace(".", "\\.") for n in names) + ")(/|$)')"

    return f"""with f as (select distinct repository_id, path, {_path()} as p, lower(regexp_extract(path, '[^/]*$')) as b from repository_files)
      select repository_id, case when b in ({locks}) or b like '_%.lock' or b like '_%.cache' then 'lock_file' when {inside(fl.VENDORED)} then 'vendored_dependency' when {inside(fl.OUTPUT)} then 'generated_output'
        when {inside(['__snapshots__'])} or b like '%.snap' or regexp_matches(b, '\\.snapshot\\.[^.]+$') then 'snapshot' when regexp_matches(b, '\\.min\\.(c?js|mjs|css)$') then 'minified' when b like '_%.svg' then 'static_asset' else 'admitted' end as reason, count(*) as files from f group by 1, 2"""


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
SQL = {
    "ref_c1_intents": _intent_sql(),
    "ref_a7_roles": _role_sql(),
    "ref_n6_languages": _language_sql(),
    "ref_a12_exclusions": _exclusion_sql(),
    "ref_c6_generated_headers": f"""with t as (select doc_id, array_to_string(string_split(left(text, 2048), chr(10))[1:20], chr(10)) as h from documents where source_type = 'source_code' and text is not null)
      select doc_id from t where regexp_matches(h, {_quoted(fl.GENERATED_HEADER)}) or regexp_matches(h, {_quoted(fl.DO_NOT_EDIT)})""",
    "ref_s2_structural_terms": rf"""with t as (select query, list_filter(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(query, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), ' '), lambda x: x <> '' and x not in ({_STOP})) as f from {_Q}),
      u as (select query, unnest(f) as x, generate_subscripts(f, 1) as i from t),
      v as (select query, x, 0 as g, i, 0 as j from u union all select query, left(x, length(x) - 1), 1, i, 0 from u where length(x) > 3 and x like '%s' union all select query, left(x, length(x) - 2), 1, i, 1 from u where length(x) > 4 and x like '%ed' and x not like '%zed' union all select query, left(x, length(x) - 3), 1, i, 2 from u where length(x) > 5 and x like '%ing'),
      w as (select query, x, min((g, i, j)) as o from v group by 1, 2)
      select t.query, coalesce(string_agg(w.x, ' ' order by w.o), '') as terms from t left join w using (query) group by 1""",
    "ref_s8_symbol_terms": r"""with t as (select distinct symbol_name from document_chunks where symbol_name is not null),
      u as (select symbol_name, list_filter(regexp_split_to_array(lower(regexp_replace(symbol_name, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 1) as f from t),
      v as (select symbol_name, unnest(f) as x, generate_subscripts(f, 1) as i from u), w as (select symbol_name, x, min(i) as i from v group by 1, 2)
      select u.symbol_name, coalesce(string_agg(w.x, ' ' order by w.i), '') as terms from u left join w using (symbol_name) group by 1""",
    "ref_m7_hash_embeddings": r"""with t as (select distinct title from documents where title is not null), w as (select title, unnest(regexp_extract_all(lower(title), '[a-z0-9_]+')) as w from t),
      b as (select title, ('0x' || substr(sha256(w), 1, 8))::bigint % 64 as k, sum(case when ('0x' || substr(sha256(w), 9, 2))::int % 2 = 0 then 1 else -1 end) as v from w group by 1, 2),
      n as (select title, sum(v * v) as s from b group by 1) select t.title, 64 as dimensions, case when coalesce(n.s, 0) > 0 then 1.0 else 0.0 end::double as length from t left join n using (title)""",
}
