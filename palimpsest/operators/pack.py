"""Evidence packs: what is chosen, merged and cut to a budget of characters.

Choosing anchors, merging overlaps and spreading support depend on what was taken before, over a few dozen rows
a query at most; they run as one grouped stage a query. The raw baseline is a running sum and needs no fold.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The bounds of a pack.
BUDGET, ANCHORS, PER_ANCHOR, MIN_BUDGET = 30_000, 5, 2, 256
MARKER = "\n[truncated to context budget]"


def raw_top(ranked: DataFrame, budget: int, rank: str = "rank", content: str = "content") -> DataFrame:
    """Whole items in order until the first that does not fit, which is cut; nothing after it. Adds `kept`, its characters, to the rows taken."""
    w = Window.partitionBy("query_id").orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.length(content)
    d = ranked.withColumn("__sum", F.sum(n).over(w))
    before = F.col("__sum") - n
    d = d.withColumn("kept", F.when(F.col("__sum") <= budget, n).when(before < budget, (F.lit(budget) - before)).otherwise(F.lit(0)).cast("int"))
    return d.filter((F.col("kept") > 0) | ((n == 0) & (F.col("__sum") <= budget))).drop("__sum")


def truncate(text: str, room: int) -> str:
    """Cut to `room` code points, at a line boundary and with a marker where there is room for it."""
    if len(text) <= room:
        return text
    keep = room - len(MARKER)
    if keep <= 0:
        return text[: max(room, 0)]
    head = text[:keep]
    cut = head.rfind("\n")
    return (head[:cut] if cut > 0 else head) + MARKER


def _anchor_priority(role: str, intents: set[str]) -> int:
    """How early a role is wanted among anchors, by the first intent that has a say."""
    production = {"production_implementation": 1}
    # The roles that each intent wants, in order, and the place of all others.
    orders = [
        ("tests", {**dict.fromkeys(("unit_test", "integration_test", "e2e_test"), 0), **production}, 2),
        ("configuration", {"configuration": 0, **production}, 2),
        ("database_schema", {"database_schema": 0, "migration": 1, "production_implementation": 2}, 3),
        ("migration", {"migration": 0, "database_schema": 1, "production_implementation": 2}, 3),
        ("api_endpoint", {"production_implementation": 0, "api_definition": 1, "documentation": 2, "generated_reference_documentation": 2}, 3),
        ("history_rationale", {"development_history": 0}, 1),
        ("implementation", {"production_implementation": 0, "type_definition": 1, "unit_test": 2, "integration_test": 2, "e2e_test": 2}, 3),
    ]
    for intent, order, rest in orders:
        if intent in intents:
            return order.get(role, rest)
    return 0


def select_anchors(rows: list[dict], intents: set[str], limit: int = ANCHORS) -> list[dict]:
    """Exact matches first, then by role and rank; a row that repeats the content, symbol or path of a chosen one is passed over."""
    ordered = sorted(rows, key=lambda r: (not r.get("exact"), _anchor_priority(r["role"], intents), r["rank"], r["chunk_id"]))
    out, contents, symbols, paths = [], set(), set(), set()
    for r in ordered:
        symbol = r["symbol_id"] or r["symbol_name"]
        key = (r["path"], symbol, r["symbol_part"]) if r["path"] and symbol else None
        if r["content"] in contents or (key and key in symbols) or (r["path"] and r["path"] in paths):
            continue
        out.append(r)
        contents.add(r["content"])
        if key:
            symbols.add(key)
        if r["path"]:
            paths.add(r["path"])
        if len(out) == limit:
            break
    return out


def _same_symbol(a: dict, b: dict) -> bool:
    if a["symbol_id"] and a["symbol_id"] == b["symbol_id"] and a["symbol_part"] == b["symbol_part"]:
        return True
    return a["symbol_name"] is not None and a["symbol_name"] == b["symbol_name"] and a["symbol_kind"] == b["symbol_kind"]


def _spliced(a: dict, b: dict) -> tuple[str, int, int] | None:
    """Two ranges of one symbol as one text, if they overlap and agree where they do."""
    if not a["path"] or a["path"] != b["path"] or not _same_symbol(a, b) or None in (a["start_line"], a["end_line"], b["start_line"], b["end_line"]):
        return None
    (s, e), (t, f) = (int(a["start_line"]), int(a["end_line"])), (int(b["start_line"]), int(b["end_line"]))
    x, y = a["content"].split("\n"), b["content"].split("\n")
    if s > f or t > e or len(x) != e - s + 1 or len(y) != f - t + 1:
        return None
    if any(x[i - s] != y[i - t] for i in range(max(s, t), min(e, f) + 1)):
        return None
    first, last = min(s, t), max(e, f)
    lines = dict(enumerate(x, s)) | dict(enumerate(y, t))
    return "\n".join(lines[i] for i in range(first, last + 1)), first, last


def merge(rows: list[dict], log: list[tuple]) -> list[dict]:
    """Candidates in their order without repeats: equal chunks or contents join their reasons, overlapping ranges their lines."""
    kept: list[dict] = []
    by_id: dict[str, dict] = {}
    by_text: dict[str, dict] = {}
    for r in rows:
        old = by_id.get(r["chunk_id"]) or by_text.get(r["content"])
        action = "deduplicated"
        if old is None:
            for k in kept:
                joined = _spliced(k, r)
                if joined:
                    k["content"], k["start_line"], k["end_line"] = joined
                    old, action = k, "merged"
                    break
        if old is None:
            r["reasons"] = list(r["reasons"])
            kept.append(r)
            by_id[r["chunk_id"]] = by_text[r["content"]] = r
            continue
        old["reasons"] += [x for x in r["reasons"] if x not in old["reasons"]]
        log.append((r["chunk_id"], action))
    return kept


def spread(rows: list[dict]) -> list[dict]:
    """Support in turns: by priority, then paths and roles used least so far, then the order given."""
    rest, out, paths, roles = list(rows), [], {}, {}
    while rest:
        best = min(rest, key=lambda r: (r["priority"], paths.get(r["spread_key"], 0), roles.get(r["context_role"], 0), r["sequence"], r["chunk_id"]))
        rest.remove(best)
        out.append(best)
        paths[best["spread_key"]] = paths.get(best["spread_key"], 0) + 1
        roles[best["context_role"]] = roles.get(best["context_role"], 0) + 1
    return out


def fill(rows: list[dict], budget: int, log: list[tuple]) -> list[dict]:
    """Primary items share the budget fairly and are cut to their share; support is taken whole while it fits, else passed over."""
    primary = [r for r in rows if "retrieved_primary" in r["reasons"]]
    support = [r for r in rows if "retrieved_primary" not in r["reasons"]]
    used, out = 0, []
    for i, r in enumerate(primary):
        text = truncate(r["content"], (budget - used) // (len(primary) - i))
        used += len(text)
        out.append(r | {"text": text})
        log.append((r["chunk_id"], "truncated" if len(text) < len(r["content"]) else "included"))
    for r in spread(support):
        if used + len(r["content"]) > budget:
            log.append((r["chunk_id"], "rejected_budget"))
            continue
        used += len(r["content"])
        out.append(r | {"text": r["content"]})
        log.append((r["chunk_id"], "included"))
    return out


_TEST_ROLES = ("unit_test", "integration_test", "e2e_test")
_CONTEXT = {**dict.fromkeys(_TEST_ROLES, "TEST"), "configuration": "CONFIGURATION", "database_schema": "SCHEMA", "migration": "SCHEMA", "development_history": "HISTORY", "type_definition": "TYPE_OR_INTERFACE"}


def context_role(role: str, origin: str, relation: str | None) -> str:
    if origin == "local":
        return "TYPE_OR_INTERFACE" if role == "type_definition" else "LOCAL_CONTEXT"
    if role in _CONTEXT:
        return _CONTEXT[role]
    if origin == "primary":
        return "PRIMARY"
    return {"imported_by": "CALLER", "imports": "DEPENDENCY", "reexports": "DEPENDENCY"}.get(relation or "", "SUPPORTING_IMPLEMENTATION")


def relation_priority(rank: int, role: str, relation: str | None, intents: set[str]) -> int:
    """30 plus the neighbour's rank, less where the role is what the query is after."""
    back = relation == "imported_by"
    if "tests" in intents:
        change = -15 if role == "production_implementation" else 0
    elif "configuration" in intents:
        change = -18 if role == "configuration" else -12 if back else 0
    elif "database_schema" in intents:
        change = -18 if role == "database_schema" else -10 if role == "production_implementation" else 0
    elif "exact_symbol" in intents:
        change = -5 if back else -10
    elif "implementation" in intents:
        change = {"production_implementation": -12, "type_definition": -8}.get(role, 4 if role in _TEST_ROLES else 0)
    else:
        change = 0
    return 30 + rank + change


COLUMNS = ["query_id", "chunk_id", "origin", "rank", "exact", "role", "path", "source_reference", "symbol_id", "symbol_name", "symbol_kind", "symbol_part", "start_line", "end_line", "content", "relation", "reason", "priority"]
_OUT = "query_id {}, item int, chunk_id string, context_role string, reasons string, start_line int, end_line int, characters int, original_characters int, truncated boolean, content string"


def build(candidates: DataFrame, intents: DataFrame, budget: int = BUDGET, limit: int = ANCHORS) -> DataFrame:
    """The pack of each query, one row an item in order.

    `candidates` has COLUMNS, origin being primary, local or relation (rank is the retrieval, local or
    relationship rank, priority that of local context); `intents` has (query_id, intents array). Anchors are
    chosen among the primary rows. Contents and paths may be null; null contents are empty texts.
    """
    kind = dict(candidates.dtypes)["query_id"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        query, out, _ = _packed(pdf, budget, limit)
        return pd.DataFrame(
            [(query, i, r["chunk_id"], r["context_role"], ",".join(r["reasons"]), r["start_line"], r["end_line"], len(r["text"]), len(r["content"]), len(r["text"]) < len(r["content"]), r["text"]) for i, r in enumerate(out, 1)],
            columns=[x.split()[0] for x in _OUT.format(kind).split(", ")],
        ).astype({"start_line": "Int32", "end_line": "Int32"})

    return _grouped(candidates, intents).applyInPandas(one, _OUT.format(kind))


def decisions(candidates: DataFrame, intents: DataFrame, budget: int = BUDGET, limit: int = ANCHORS) -> DataFrame:
    """Why each candidate of a pack is in it or not: rows (query_id, step, chunk_id, action), in the order decided.

    Actions: selected and rejected_anchor for the primary rows, deduplicated and merged for repeats, then included,
    truncated and rejected_budget.
    """
    kind = dict(candidates.dtypes)["query_id"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        query, _, log = _packed(pdf, budget, limit)
        return pd.DataFrame([(query, i, c, a) for i, (c, a) in enumerate(log, 1)], columns=["query_id", "step", "chunk_id", "action"])

    return _grouped(candidates, intents).applyInPandas(one, f"query_id {kind}, step int, chunk_id string, action string")


def chosen(candidates: DataFrame, intents: DataFrame, limit: int = ANCHORS) -> DataFrame:
    """The anchors of each query among its primary rows: rows (query_id, chunk_id, anchor)."""
    kind = dict(candidates.dtypes)["query_id"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        for r in rows:
            r["content"] = r["content"] or ""
        wanted = set(rows[0]["intents"]) if rows[0]["intents"] is not None else set()
        out = select_anchors(sorted(rows, key=lambda r: (r["rank"], r["chunk_id"])), wanted, limit)
        return pd.DataFrame([(r["query_id"], r["chunk_id"], i) for i, r in enumerate(out, 1)], columns=["query_id", "chunk_id", "anchor"])

    return _grouped(candidates.filter("origin = 'primary'"), intents).applyInPandas(one, f"query_id {kind}, chunk_id string, anchor int")


def _grouped(candidates: DataFrame, intents: DataFrame):
    c = candidates
    for name in ("relation", "reason"):
        c = c if name in c.columns else c.withColumn(name, F.lit(None).cast("string"))
    c = c if "priority" in c.columns else c.withColumn("priority", F.lit(None).cast("int"))
    return c.select(*COLUMNS).join(intents.select("query_id", "intents"), "query_id").groupBy("query_id")


def _packed(pdf: pd.DataFrame, budget: int, limit: int) -> tuple:
    """(query, items in order, decisions) of one query's candidates."""
    rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
    wanted = set(rows[0]["intents"]) if rows and rows[0]["intents"] is not None else set()
    for r in rows:
        r["content"] = r["content"] or ""
    primary = sorted((r for r in rows if r["origin"] == "primary"), key=lambda r: (r["rank"], r["chunk_id"]))
    chosen = select_anchors(primary, wanted, limit)
    taken = {r["chunk_id"] for r in chosen}
    log: list[tuple] = [(r["chunk_id"], "selected" if r["chunk_id"] in taken else "rejected_anchor") for r in primary]
    items = []
    for i, r in enumerate(chosen, 1):
        items.append(r | {"reasons": ["retrieved_primary"], "context_role": context_role(r["role"], "primary", None), "priority": i})
    # a question about history is answered by what was said then: the present source around it is no evidence
    for origin in () if "history_rationale" in wanted else ("local", "relation"):
        for r in sorted((r for r in rows if r["origin"] == origin), key=lambda r: (r["rank"], r["chunk_id"])):
            p = r["priority"] if origin == "local" else relation_priority(int(r["rank"]), r["role"], r["relation"], wanted)
            items.append(r | {"reasons": [r["reason"] or origin], "context_role": context_role(r["role"], origin, r["relation"]), "priority": int(p)})
    for n, r in enumerate(items):
        r["sequence"], r["spread_key"], r["original"] = n, r["path"] or r["source_reference"] or "", len(r["content"])
    items.sort(key=lambda r: (r["priority"], r["spread_key"], r["sequence"], r["chunk_id"]))
    return rows[0]["query_id"], fill(merge(items, log), budget, log), log


def repeated_evidence(items: DataFrame) -> DataFrame:
    """Per query the items that repeat an earlier one: equal content, or an overlapping range of the same path and symbol."""
    kind = dict(items.dtypes)["query_id"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("item").astype(object).where(pdf.notna(), None).to_dict("records")
        kept: list[dict] = []
        n = 0
        for r in rows:
            hit = any(
                r["content"] == k["content"]
                or (r["path"] and r["path"] == k["path"] and r["symbol_name"] == k["symbol_name"] and None not in (r["start_line"], r["end_line"], k["start_line"], k["end_line"]) and r["start_line"] <= k["end_line"] and k["start_line"] <= r["end_line"])
                for k in kept
            )
            n += hit
            if not hit:
                kept.append(r)
        return pd.DataFrame({"query_id": [rows[0]["query_id"]], "items": [len(rows)], "repeated": [n]})

    return items.groupBy("query_id").applyInPandas(one, f"query_id {kind}, items int, repeated int")
